from pyspark.sql import functions as F

from corvina.operators import entities, metrics


def test_latency_summary(spark):
    df = spark.createDataFrame([("k", float(x)) for x in (30, 10, 20, 100)], "k string, ms double")
    r = metrics.latency(df, ["k"], "ms").first()
    assert (r["count"], r.min_ms, r.p50_ms, r.p95_ms, r.p99_ms, r.max_ms) == (4, 10, 20, 100, 100, 100)


def test_canonical_identity_backfill_is_idempotent(spark):
    ent = spark.createDataFrame([("company", "e1", "Acme, Inc.")], "type string, entity_id string, identity_key string")
    refs = spark.createDataFrame([("o1", "parent", "company", "acmeinc")], "source_id string, rel_type string, target_type string, value string")
    found = entities.relationship_candidates(refs, entities.aliases(ent))
    assert found.count() == 1
    none = found.limit(0)
    assert entities.missing_edges(found, none).count() == 1
    assert entities.missing_edges(found, none.union(found)).count() == 0


def test_failures(spark):
    rows = [("Vectorize timed out", "embedding_readiness", True), ("R2 object not found", "missing_source_object", False), ("", "none", False), ("boom", "unknown", True)]
    df = spark.createDataFrame(rows, "m string, c string, r boolean")
    for r in df.select("c", "r", metrics.failure_category(F.col("m")).alias("gc"), metrics.failure_retryable(F.col("m")).alias("gr")).collect():
        assert (r.gc, r.gr) == (r.c, r.r)
