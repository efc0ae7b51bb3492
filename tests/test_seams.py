import json

from corvina.operators import seams


def test_neural_rerank(spark):
    rows = [(q, "ferry dawn", f"c{k}", f"text {k} ferry" + " dawn" * (k == 2), 1.0 / k, k) for q in (1, 2, 3) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "qid long, query string, chunk_id string, content string, score double, rank int")

    def model(query, texts):
        if not texts[0].startswith("text 1"):
            raise RuntimeError("order")
        return [(2, 0.9), (0, 0.9), (7, 5.0), (1, float("nan"))]

    got = {(r.qid, r["rank"]): (r.chunk_id, r.how, round(r.retrieval_score, 3)) for r in seams.neural_rerank(df.filter("qid = 1"), 3, model).collect()}
    assert got == {(1, 1): ("c1", "model", 1.0), (1, 2): ("c3", "model", 0.333)}

    def broken(query, texts):
        raise TimeoutError("slow")

    for bad in (broken, lambda q, t: []):
        got = [(r.chunk_id, r.how) for r in seams.neural_rerank(df.filter("qid = 2"), 2, bad).orderBy("rank").collect()]
        assert got == [("c1", "keyword"), ("c2", "keyword")]
    best = [r.chunk_id for r in seams.neural_rerank(df, 1).orderBy("qid").collect()]
    assert best == ["c2"] * 3


def test_written_answers(spark):
    schema = "qid long, question string, extractive string, citations array<struct<index:int,excerpt:string>>, retrieved array<string>"
    df = spark.createDataFrame([(k, f"q{k}", "The ferry. [1]", [(1, "ferry"), (2, "dawn")], ["whole text"]) for k in range(6)], schema)
    replies = {"q0": "At dawn [2].", "q1": "At dawn.", "q2": "At dawn [3].", "q3": '{"answer": "Dawn [1]", "x": 1}', "q4": ""}

    def model(question, evidence):
        assert evidence == "[1] ferry\n[2] dawn\nretrieved 1: whole text"
        return replies[question]

    got = {r.qid: (r.answer, r.mode, r.fallback) for r in seams.written_answers(df, model).collect()}
    kept = "The ferry. [1]"
    assert got == {
        0: ("At dawn [2].", "model", None), 1: (kept, "extractive", "empty or uncited response"), 2: (kept, "extractive", "cites what is not there"), 3: ("Dawn [1]", "model", None),
        4: (kept, "extractive", "empty or uncited response"), 5: (kept, "extractive", "KeyError: 'q5'"),
    }
    assert {r.mode for r in seams.written_answers(df).collect()} == {"extractive"}


def test_verdicts(spark):
    df = spark.createDataFrame([(k, f"q{k}", "ferry sails dawn", "the ferry sails") for k in range(5)], "id long, question string, answer string, evidence string")

    def model(asked, evidence):
        k = int(json.loads(asked)["question"][1:])
        return ['Sure: {"status": "supported", "score": 7}', '{"status": "fine"}', "no", '{"status": "partial", "score": "x"}', None][k]

    assert {r.id: (r.status, r.score, r.error) for r in seams.verdicts(df, model).collect()} == {0: ("supported", 1.0, None), 1: (None, None, "no verdict"), 2: (None, None, "no verdict"), 3: ("partial", None, None), 4: (None, None, "no verdict")}
    assert {(r.status, round(r.score, 3)) for r in seams.verdicts(df).collect()} == {("supported", 0.667)}
