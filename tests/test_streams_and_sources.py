"""State machines over replayed streams, the manifest reader, the telemetry sink and boundary chunks."""

import datetime as dt
import itertools
import json
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvina.operators import boundaries, vector
from corvina.sources import manifest
from corvina.streaming import jobs

T0 = dt.datetime(2024, 5, 1)


def replay(spark, folder, schema, batches, made):
    """Rows that a stream writes which reads one file a batch."""
    os.makedirs(f"{folder}/in")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/in")
        for f in os.listdir(f"{folder}/in"):
            if f.startswith("part"):
                os.rename(f"{folder}/in/{f}", f"{folder}/in/b{n:03}.json")
                os.utime(f"{folder}/in/b{n:03}.json", (1e9 + n, 1e9 + n))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in/b*.json")
    out = made(source)
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def test_job_history(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [
        [("a", 1, at(0), "done"), ("b", 3, at(2), "failed"), ("b", 2, at(1), "done"), ("c", 4, at(3), "failed")],
        [("a", 5, at(60), "done"), ("c", 6, at(61), "failed")],
        [("a", 7, at(200), "done"), ("c", 8, at(201), "failed"), ("d", 9, at(202), "failed")],
        [("a", 10, at(300), "failed"), ("d", 11, at(301), "cancelled")],
        [("e", 12, at(900), "done")],
    ]
    rows = replay(spark, str(tmp_path), "job_id string, event_id long, at timestamp, event string", batches, jobs.job_history)
    got = {}
    for r in sorted(rows, key=lambda r: (r.job_id, r.seq)):
        got.setdefault(r.job_id, []).append((int((r.at - T0).total_seconds()), r.event, r.status, r.stage, r.attempts))
    assert got == {
        "a": [(0, "done", "running", "index", 0), (60, "done", "running", "extract", 0), (200, "done", "succeeded", "extract", 0), (300, "ignored", "succeeded", "extract", 0)],
        # The delay after the first failure is ten seconds.
        "b": [(1, "done", "running", "index", 0), (2, "failed", "waiting", "index", 1), (12, "retry", "running", "index", 1)],
        "c": [(3, "failed", "waiting", "parse", 1), (13, "retry", "running", "parse", 1), (61, "failed", "waiting", "parse", 2), (81, "retry", "running", "parse", 2), (201, "failed", "dead_letter", "parse", 3)],
        "d": [(202, "failed", "waiting", "parse", 1), (212, "retry", "running", "parse", 1), (301, "cancelled", "cancelled", "parse", 1)],
        "e": [(900, "done", "running", "index", 0)],
    }


def test_sessions(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[("x", 1, at(0), "hi"), ("x", 2, at(20), "there")], [("y", 3, at(25), "me"), ("x", 4, at(49), "again")], [("z", 5, at(200), "late")], [("x", 6, at(230), "back"), ("y", 7, at(231), "too"), ("y", 8, at(280), "new")]]
    rows = replay(spark, str(tmp_path), "session_id string, event_id long, at timestamp, turn string", batches, lambda s: jobs.sessions(s, 30))
    got = sorted((r.session_id, r.number, int((r.ended - T0).total_seconds()), r.turns, list(r.tail)) for r in rows)
    assert got == [("x", 0, 49, 3, ["hi", "there", "again"]), ("x", 1, 230, 1, ["back"]), ("y", 0, 25, 1, ["me"]), ("y", 1, 231, 1, ["too"]), ("z", 0, 200, 1, ["late"])]


def test_manifest(spark, tmp_path):
    local = tmp_path / "notes.md"
    local.write_text("# kept")
    urls = ["https://h.example/a/b%20c.pdf?x=1#y", "https://h.example/", "https://h.example/readme", str(local), "file:///nowhere/gone.txt", None, "https://h.example/big.txt"]
    content = [b"%PDF", "<p>é</p>".encode(), b"", None, None, b"x", b"x" * 50]
    table = pa.table({"url": urls, "content": pa.array(content, pa.binary()), "mime": [None, "text/html; charset=utf-8", "text/plain", None, None, None, None], "note": range(7)})
    pq.write_table(table, tmp_path / "m.parquet", row_group_size=2)
    manifest.register(spark)
    df = spark.read.format("corvina_manifest").option("path", str(tmp_path / "m.parquet")).option("maxBytes", 40).load()
    assert df.rdd.getNumPartitions() == 4
    got = [(r.url, r.filename, r.mime, r.bytes, r.content and bytes(r.content), (r.error or "").split(":")[0]) for r in df.collect()]
    assert got == [
        (urls[0], "b_c.pdf", "application/pdf", 4, b"%PDF", ""), (urls[1], "index.html", "text/html", 9, content[1], ""), (urls[2], "readme.txt", "text/plain", 0, b"", ""),
        (urls[3], "notes.md", "text/markdown", 6, b"# kept", ""), (urls[4], None, None, None, None, "FileNotFoundError"), (None, "index.html", "text/html", 1, b"x", ""),
        (urls[6], "big.txt", "text/plain", 50, None, "larger than 40 bytes"),
    ]


def test_telemetry_sink(spark, tmp_path):
    manifest.register(spark)
    os.makedirs(tmp_path / "in")
    for n in range(3):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"route": f"r{k}", "ms": n * 10 + k}) for k in range(4)))
    root, schema = str(tmp_path / "sink"), "route string, ms long"
    run = lambda c: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).writeStream.format("corvina_telemetry").option("path", root).option("checkpointLocation", str(tmp_path / c)).trigger(availableNow=True).start().awaitTermination()
    assert manifest.telemetry(spark, root, schema).count() == 0
    run("c1")
    assert sorted(r.ms for r in manifest.telemetry(spark, root, schema).collect()) == sorted(n * 10 + k for n in range(3) for k in range(4))
    run("c2")  # the same batches again: their commits are there, their rows don't count twice
    assert manifest.telemetry(spark, root, schema).count() == 12
    committed = {f for c in os.listdir(f"{root}/commits") for f in json.load(open(f"{root}/commits/{c}"))["files"]}
    assert committed == {f"{root}/staging/{f}" for f in os.listdir(f"{root}/staging")}
    w = manifest.TelemetryWriter({"path": root})
    staged = w.write(iter([spark.createDataFrame([("a", 1)], schema).first()]))
    w.abort([staged, None], 9)
    assert not os.path.exists(staged.file) and manifest.telemetry(spark, root, schema).count() == 12


TEXTS = ["", "One. Two! Three? " * 3, "Intro\n\nFirst words here. More of them.\n\n# Part two\nText follows. And on it goes until the end.\n\nPART THREE\nlast. words.", "x" * 95, "a b. " * 4 + "\n\n" + "y" * 47 + ". z"]


def everything(text, size, band):
    """The least cost of all ways to cut, and the way with the longest first chunks of that cost."""
    at = [(0, "heading"), *boundaries.places(text, size)]
    n, found = len(at) - 1, []
    for inner in itertools.chain.from_iterable(itertools.combinations(range(1, n), k) for k in range(n)):
        ends = [0, *inner, n]
        if any(at[j][0] - at[i][0] > size * (1 + band) and j > i + 1 for i, j in zip(ends, ends[1:])):
            continue
        cost = 0.0
        for i, j in reversed(list(zip(ends, ends[1:]))):
            cost = boundaries._cost(at[j][0] - at[i][0], at[j][1], j == n, size, band) + cost
        found.append((cost, [-at[j][0] for j in ends[1:]]))
    return [-e for e in min(found)[1]]


@pytest.mark.parametrize("size", [20, 33, 60])
def test_boundaries_equal_an_exhaustive_search(size):
    rng = random.Random(size)
    texts = TEXTS[1:] + ["".join(rng.choice(["ab ", "cd. ", "\n\n", "Head\n", "efg! "]) for _ in range(22)) for _ in range(40)]
    for text in texts:
        if not text or len(boundaries.places(text, size)) > 15:
            continue
        got = boundaries.cuts(text, size, 0.2)
        assert "".join(text[a:b] for a, b, _ in got) == text
        assert [b for _, b, _ in got] == everything(text, size, 0.2)


def test_boundary_chunks(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate([None, *TEXTS])], "doc_id long, text string, start int")
    got = boundaries.chunk_at_boundaries(df, 60).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.chunk_index)):
        assert r.start == len(whole.get(r.doc_id, "")) and len(r.content) == r.end - r.start <= 72
        whole[r.doc_id] = whole.get(r.doc_id, "") + r.content
    assert whole == {k: t for k, t in enumerate([None, *TEXTS]) if t}
    assert [(r.content.split("\n")[0], r.section) for r in got if r.doc_id == 3] == [("Intro", "Intro"), ("# Part two", "Part two"), ("PART THREE", "PART THREE")]


def test_approximate_top_k(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(25)]
    rows = [(k, [c + rng.gauss(0, 0.7) for c in centres[k % 25]]) for k in range(3000)]
    rows += [(3000 + k, rows[11][1]) for k in range(700)] + [(9001, None), (9002, [0.0] * 32), (9003, [1.0]), (9004, [float("nan")] * 32)]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(6)
    q = v.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query_vector"))
    index = vector.inverted_lists(v, 32)
    assert index.rows.count() == 3700 and len(index.centroids) == 61
    pairs = lambda df: {(r.qid, r.id) for r in df.collect()}
    exact = pairs(vector.top_k(v, q, 10))
    assert len(pairs(vector.approximate_top_k(index, q, 10)) & exact) >= 0.95 * len(exact)
    whole = vector.approximate_top_k(index, q, 10, probes=len(index.centroids))
    assert pairs(whole) == exact
    index.drop()


def test_recall_on_the_test_table(spark):
    from corvina import catalog

    sf = "/root/testdata/sf0.01"
    got = {(r.qid, r.id) for r in catalog.Q["vector_topk_approximate"](spark, sf).collect()}
    want = {(r.qid, r.id) for r in vector.top_k(spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id as id", "embedding as vector"), spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 50 = 0").selectExpr("vec_id as qid", "embedding as query_vector"), 10).collect()}
    assert len(got & want) >= 0.95 * len(want)
