"""Embedding batches, vector ingest, uploads, filings, objects and record ingest."""

import json
import math

import pytest
from pyspark.sql import functions as F

from corvina.operators import control, embedding, metrics
from corvina.plans import search, structured
from corvina.sources import filings, objects, parsers

BASE, SMALL = embedding.Profile("base", "base", 3, "big"), embedding.Profile("small", "small", 2, "tiny")
CATALOG = [embedding.Model("big", "north", 3, ("b",)), embedding.Model("tiny", "south", 2), embedding.Model("old", "north", 3, enabled=False), embedding.Model("odd", "north", 5)]


def test_profiles():
    new = lambda **k: embedding.resolve_new([BASE, SMALL], CATALOG, **k)
    assert (new().model, new(kind="small").provider, new(model="b").dimensions) == ("big", "south", 3)
    for wrong, said in (({"model": "none"}, "not available"), ({"model": "old"}, "disabled"), ({"model": "odd"}, "do not match"), ({"model": "big", "provider": "south"}, "mismatch"), ({"model": "tiny", "kind": "base"}, "not compatible")):
        with pytest.raises(ValueError, match=said):
            new(**wrong)
    old = lambda *a, **k: embedding.resolve_index([BASE, SMALL, embedding.Profile("wide", "base", 9)], CATALOG, *a, **k)
    assert old(2, None).model == "tiny" and old(3, "b").model == "big" and old(3, "b", kind="small").dimensions == 2
    for wrong, said in (((9, None), "no stored"), ((4, None), "do not match")):
        with pytest.raises(ValueError, match=said):
            old(*wrong)


def test_calls():
    waits, busy = [], [embedding.Busy(9.0), embedding.Busy()]

    def provider(texts):
        if busy:
            raise busy.pop(0)
        return [(len(texts) - 1 - k, [float(k)] * 2) for k in range(len(texts))]

    assert embedding.called(provider, ["a", "b", "c"], 2, waits.append) == [[2.0, 2.0], [1.0, 1.0], [0.0, 0.0]]
    assert waits == [4.0, 0.8]
    busy += [embedding.Busy()] * 3
    with pytest.raises(embedding.Busy):
        embedding.called(provider, ["a"], 2, waits.append)
    for rows, said in (([[1.0, 2.0]], "count mismatch"), ([[1.0], [2.0]], "expected 2, got 1"), ([[1.0, math.inf]] * 2, "finite")):
        with pytest.raises(ValueError, match=said):
            embedding.called(lambda t, rows=rows: rows, ["a", "b"], 2)


def test_each_text_is_embedded_once(spark, tmp_path):
    use = embedding.Resolved(SMALL, "tiny", "south", 2)
    log = str(tmp_path)

    def provider(texts):
        import os
        import uuid

        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(k, ["x", "yy", None, ""][k % 4]) for k in range(900)], "id long, content string")
    made, cache = embedding.embed(rows, use, provider)
    assert {(r.id, r.vector[0]) for r in made.collect()} == {(k, [1.0, 2.0, 0.0, 0.0][k % 4]) for k in range(900)}
    said = [line for f in tmp_path.iterdir() for line in f.read_text().split("\n")]
    assert sorted(said) == ["", "x", "yy"]
    more, cache = embedding.embed(spark.createDataFrame([(1, "x"), (2, "new")], "id long, content string"), use, provider, cache)
    assert {(r.id, r.vector[0]) for r in more.collect()} == {(1, 1.0), (2, 3.0)} and cache.count() == 4
    assert sorted(line for f in tmp_path.iterdir() for line in f.read_text().split("\n")) == ["", "new", "x", "yy"]


def test_vector_tables(spark):
    t = lambda rows: spark.createDataFrame(rows, "namespace string, id string, vector array<double>")
    one = embedding.upsert_vectors(None, t([("a", "1", [1.0]), ("a", "1", [0.5]), ("b", "1", [2.0])]))
    two = embedding.upsert_vectors(one, t([("a", "1", [9.0]), ("a", "2", [8.0])]))
    assert {(r.namespace, r.id, r.vector[0]) for r in two.collect()} == {("a", "1", 9.0), ("a", "2", 8.0), ("b", "1", 2.0)}
    with pytest.raises(ValueError):
        embedding.backfill(t([("a", "1", [1.0]), ("a", "2", [1.0, 2.0])]), 10)
    batches = embedding.backfill(spark.range(1000).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0)).alias("vector")), 100).groupBy("batch").count().collect()
    assert len(batches) == 10 and sum(r["count"] for r in batches) == 1000


def test_vector_chunks(spark):
    schema = "request string, pos int, id string, document_id string, content string, embedding array<double>, chunk_index int, document_content string"
    rows = [
        ("r1", 0, "a", "d1", "one", [1.0, 2.0], None, None), ("r1", 1, "b", "d2", "two", [1.0, 2.0], 7, "whole"), ("r1", 2, "c", "d2", "three", [1.0, 2.0], None, None),
        ("r2", 0, "d", "d3", "x", [1.0, 2.0], None, None), ("r2", 1, "e", "d3", "x", [1.0, float("nan")], None, None), ("r3", 0, " ", "d4", "x", [1.0], None, None), ("r4", 0, "f", "d5", "x", None, None, None),
    ]
    good, new, bad = embedding.vector_chunks(spark.createDataFrame(rows, schema), spark.createDataFrame([("d1",)], "document_id string"), 2)
    assert {(r.id, r.chunk_index) for r in good.collect()} == {("a", 0), ("b", 7), ("c", 2)}
    assert [tuple(r) for r in new.collect()] == [("d2", "whole")]
    assert {(r.request, r.problem) for r in bad.collect()} == {("r2", "not finite"), ("r3", "chunk id is required"), ("r4", "embedding is required")}


def test_documents_without_ids(spark):
    docs = spark.createDataFrame([("same", 1), ("same", 1), ("other", 1)], "content string, n int")
    ids = lambda run: sorted(r.document_id for r in embedding.with_ids(docs, "i", run).collect())
    assert ids("one") == ids("one") != ids("two") and len(set(ids("one"))) == 3


def test_formats():
    assert [parsers.format_of(*a) for a in (("a.PDF", None), ("a", "application/pdf"), ("x/y", "text/html; charset=x"), ("a.docx", "text/html"), ("a.b/c", None), ("n.md", "text/markdown"))] == ["pdf", "pdf", "html", "docx", "text", "text"]
    wants = [(m, n, w, p, t) for m, n, w, p, t in (("auto", 1, 50, "a.pdf", None), ("auto", 0, 0, "a.pdf", None), ("auto", 1, 3, "a.html", None), ("auto", 1, 3, "a.txt", None), ("auto", 1, 50, "a.PNG", None), ("always", 1, 50, "a.docx", None), ("always", 1, 50, "a.txt", None), ("off", 0, 0, "a.png", None), ("auto", 1, 99, "a", "image/png"))]
    assert [parsers.needs_conversion(*w) for w in wants] == [False, True, True, False, True, True, False, False, True]


def test_uploads(spark):
    def convert(path, raw):
        if "bad" in path:
            raise RuntimeError("no")
        return "Scan text\n\n| a | b |\n| 1 | 2 |\n" if path.endswith("png") else "few words"

    files = [("a.png", None, b"\x89"), ("b.html", None, b"<p>few words</p>"), ("c", "text/csv", b"x,y\n1,2\n3,4"), ("bad.gif", None, b""), ("d.txt", None, b'[{"k": 1}]'), ("e.bin", "application/x", b"raw words"), ("f.png", None, None)]
    df = spark.createDataFrame(files, "path string, mime string, content binary")
    got = {}
    for r in parsers.parse_files(df, "auto", convert).orderBy("path", "doc_index").collect():
        got.setdefault(r.path, []).append((r.parser, r.external_id and r.external_id.split(":", 1)[1], r.content, r.warning))
    assert got["b.html"] == [("html", "text", "few words", None)]
    assert [x[1] for x in got["a.png"]] == ["text", "converted", "table:1"] and got["a.png"][2][2] == "| a | b |\n| 1 | 2 |"
    assert [json.loads(x[2]) for x in got["c"]] == [{"x": 1, "y": 2}, {"x": 3, "y": 4}] and got["d.txt"][0][1:3] == ("record:0", '{"k": 1}')
    assert got["bad.gif"] == [("text", None, None, "converter: RuntimeError")] and got["e.bin"][0][0] == "text-fallback"
    assert [x[1] for x in got["f.png"]] == ["converted", "table:1"]
    plain = {r.path: r.warning for r in parsers.parse_files(df.filter("path = 'bad.gif'"), "auto").collect()}
    assert plain == {"bad.gif": "no converter"}


def test_conversion_policy_counts_words(spark):
    rows = spark.createDataFrame([("auto", "a.html", 1, "one two"), ("auto", "a.html", 1, "w " * 9), ("off", "a.png", 0, "")], "m string, n string, d int, t string")
    assert [r[0] for r in rows.select(control.conversion_wanted(F.col("m"), F.col("n"), F.col("d"), F.col("t"))).collect()] == [True, False, False]


def test_filings(spark):
    wanted = filings.companies(spark.createDataFrame([(1, " abc ", None), (2, None, "0042"), (3, "ABC", None), (4, "zzz", None)], "pos int, ticker string, cik string"), spark.createDataFrame([("Abc", 7, "A Co")], "ticker string, cik_str long, title string"))
    assert {tuple(r) for r in wanted.collect()} == {(1, "ABC", "0000000007", "A Co"), (2, None, "0000000042", None)}
    rows = [("7", k, ["10-K", "8-K "][k % 2], f"2024-0{9 - k}-01", f"00-{k}", "d/x y.htm") for k in range(6)] + [("42", 0, "10-K", "2024-08-02", "1-1", "m.htm"), ("42", 1, "10-K", "bad", "1-2", "m.htm"), ("42", 2, "10-K", "2024-08-01", "", "m.htm"), ("9", 0, "10-K", "2024-09-01", "2", "z")]
    table = spark.createDataFrame(rows, "cik string, pos int, form string, filing_date string, accession string, primary_document string")
    now = F.lit("2024-09-10").cast("timestamp")
    got = filings.select_filings(table, wanted, ["10-K", "8-K"], 100, now, 1).orderBy("company", "pos").collect()
    assert [(r.cik[-2:], r.form, r.filing_date) for r in got] == [("07", "10-K", "2024-09-01"), ("07", "8-K", "2024-08-01"), ("42", "10-K", "2024-08-02")]
    assert got[0].url.endswith("/data/7/000/d/x y.htm") and got[0].filename == "ABC_10-K_2024-09-01_000_d_x_y.htm"
    assert filings.select_filings(table, wanted, ["10-K", "8-K"], None, now, 9, 4).count() == 4


def test_objects(spark):
    files = spark.createDataFrame([("p", "d", "b.txt", b"1"), ("p", "d", "a b.txt", b"1"), ("p", "e", "c", b"1"), ("p", "d", "n", None)], "project string, domain string, filename string, content binary")
    stored, pointers = objects.put(files)
    keys = {r.filename: r.object_key for r in pointers.collect()}
    assert keys["b.txt"] == keys["a b.txt"] and keys["b.txt"].endswith("/a_b.txt") and keys["c"] != keys["b.txt"] and stored.count() == 2
    stored, pointers = objects.put(spark.createDataFrame([("p", "d", "z", b"1"), ("p", "d", "y", b"2")], files.schema), stored)
    assert {r.filename: (r.new, r.object_key == keys["b.txt"]) for r in pointers.collect()} == {"z": (False, True), "y": (True, False)} and stored.count() == 3
    got = objects.get(stored, spark.createDataFrame([(keys["c"],), ("none",)], "object_key string"))
    assert {r.object_key: r.content and bytes(r.content) for r in got.collect()} == {keys["c"]: b"1", "none": None}


def test_records_to_answers(spark):
    text = '[{"id": 1, "title": "Gull", "harbour_id": 7, "harbour_name": "Lervik"}, {"id": 2, "title": "Tern", "harbour_id": 7, "harbour_name": "Lervik", "parent_id": 1}]'
    got = structured.ingest(spark.createDataFrame([("f", text), ("g", "no records")], "file_id string, text string"), "boats")
    ents = {(r.type, r.identity_key): r for r in got.entities.collect()}
    assert set(ents) == {("BoatRecord", "1"), ("BoatRecord", "2"), ("HarbourRecord", "7")} and ents["BoatRecord", "2"].parent_id == ents["BoatRecord", "1"].entity_id
    assert got.edges.count() == 3 and got.mentions.count() == 3
    chunks = spark.createDataFrame([("c0", "d0", 0, "The ferry to Esbjerg sails at dawn.")], "chunk_id string, document_id string, chunk_index int, content string")
    asked = spark.createDataFrame([(1, "title is tern"), (2, "ferry Esbjerg"), (3, "title is nothing known")], "qid long, query string")
    said = {r.qid: r for r in search.answer(chunks, asked, got.entities.withColumn("created_at", F.col("identity_key"))).collect()}
    assert said[1].route == "structured" and said[1].answer.startswith("Tern: {") and said[1].citation_count == 1
    assert said[2].route == "text" and "sails at dawn" in said[2].answer and said[3].answer.startswith("I cannot answer")


def test_query_eval_and_benchmark(spark):
    judged = "struct<status:string,score:double>"
    rows = [(1, True, "ferry dawn [1]", 1, "the ferry at dawn", 5.0, ("supported", 0.9)), (2, False, "unknown words here", 1, "other", 5.0, ("weak", 0.1)), (3, None, "", 0, "", 5.0, None)]
    r = metrics.query_eval(spark.createDataFrame(rows, f"id int, hit boolean, answer string, citation_count int, evidence string, latency_ms double, judged {judged}")).first()
    assert (r.cases, round(r.hit_rate, 3), round(r.citation_rate, 3), round(r.faithfulness_rate, 3), r.avg_faithfulness, r.judged, r.judge_support_rate, r.avg_judge_score) == (3, 0.333, 0.333, 0.333, 0.5, 2, 0.5, 0.5)
    samples = spark.createDataFrame([("a", 10.0, 4.0, "hit", False), ("a", 20.0, None, "miss", False), ("a", 999.0, 1.0, "hit", True)], "run string, client_ms double, server_ms double, cache string, warmup boolean")
    b = metrics.benchmark(samples).first()
    assert (b.samples, b.cache_hits, b.cache_hit_rate, b.client_p95_ms, b.server_p50_ms) == (2, 1, 0.5, 20.0, 4.0)


def test_typed_views(spark):
    rows = [{"id": 1, "name": "a", "built": "2020-01-02", "tons": 1.5, "tags": ["x"], "crew_id": 5, "crew_name": "c"}, {"id": 2, "name": "b", "built": "soon", "tons": 2, "crew_id": 5, "crew_name": "c"}, {"id": "x", "Name": "z"}]
    got = structured.ingest(spark.createDataFrame([("f", json.dumps(rows))], "file_id string, text string"), "ships")
    assert structured.typed_views(got, "t_") == ["t_ship_record", "t_crew_record"]
    made = spark.sql("select id, name, built, tons, tags, crew_id from t_ship_record")
    assert {tuple(r[:2]) for r in made.collect()} == {("1", "a"), ("2", "b"), ("x", "z")} and dict(made.dtypes)["tons"] == "double" and dict(made.dtypes)["tags"] == "array<string>"
    assert spark.sql("select sum(s.tons) t from t_ship_record s join t_crew_record c on s.crew_id = c.crew_id").first().t == 3.5
