import pytest
from pyspark.sql import functions as F

from corvina.functions import text as T
from corvina.operators import chunking


@pytest.mark.parametrize("length, starts", [(0, []), (2000, [0]), (2001, [0, 1800]), (3800, [0, 1800]), (3801, [0, 1800, 3600])])
def test_windows(spark, length, starts):
    body = "".join(chr(97 + i % 26) for i in range(length))
    got = spark.createDataFrame([(body,)], "t string").select(chunking.windows(F.col("t")).alias("c")).first().c
    assert got == [body[s : s + 2000] for s in starts]


def reference_chunks(text, size, overlap):
    out, cur = [], ""
    for p in text.split("\n\n"):
        if len(cur) + len(p) <= size:
            cur = cur + ("\n\n" if cur else "") + p
            continue
        if cur:
            out.append(cur)
            cur = ""
        if len(p) > size:
            at = 0
            while True:
                out.append(p[at : at + size])
                at += size - overlap
                if len(p) - at <= overlap:
                    break
        else:
            cur = p
    return out + ([cur] if cur else [])


def test_packed_matches_model(spark):
    texts = ["a" * 90 + "\n\n" + "b" * 20, "x" * 350 + "\n\ntail", "p\n\nq\n\n" + "r" * 120 + "\n\n" + "s" * 99, "\n\n".join("w" * n for n in range(1, 40))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.packed(F.col("t"), 100, 20).alias("c")).collect()
    for r in rows:
        assert r.c == reference_chunks(r.t, 100, 20)


def test_similarity_and_stem(spark):
    rows = [("quaysiders", "quaysders", 0.9), ("policies", "policy", 0.92), ("alpha", "alphabet", 0.82), ("cat", "car", 0.0), ("same", "same", 1.0)]
    df = spark.createDataFrame(rows, "q string, t string, want double").select("want", T.similarity(F.col("q"), F.col("t")).alias("got"))
    for r in df.collect():
        assert r.got == pytest.approx(r.want)


def test_html_and_entities(spark):
    df = spark.createDataFrame([("<h1>A &amp; B</h1><script>no()</script><p>x&#233;&#x41;</p>",)], "h string")
    assert df.select(T.strip_html(F.col("h")).alias("t")).first().t == "A & B xéA"


def test_plans_stay_native(spark):
    df = spark.createDataFrame([("c", 0, "some text")], "chunk_id string, chunk_index int, content string")
    from corvina.operators import lexical

    plan = lexical.bm25(df, spark.createDataFrame([(1, "some text")], "qid long, query string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
