"""Operational metrics: latency, ingest runs, source sets, traces, evaluations and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.text import js_round, tokens
from corvina.operators.citations import support
from corvina.operators.selection import nearest_ranks

#: Failure category by message keywords, in order of precedence, and whether a retry can help.
FAILURES = [
    ("embedding_readiness", True, ["embedding", "vectorize", "free-ai"]),
    ("missing_source_object", False, ["r2 object not found", "not found"]),
    ("parse_empty", False, ["no parseable text", "empty file", "text must be non-empty"]),
    ("validation", False, ["schema", "domain is required", "document content is required", "data must contain at least one record"]),
]
#: p95 limits (client, server) in ms for the grades S, A+, A.
LATENCY_GRADES = {
    "lexical": [(150, 100), (300, 250), (500, 400)],
    "hybrid": [(750, 600), (1000, 800), (1500, 1200)],
    "semantic": [(900, 700), (2000, 1500), (3000, 2500)],
}
GRADES = ["S", "A+", "A", "B", "C"]


def latency(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, min, p50, p95, p99, max, mean; exact nearest-rank percentiles, two decimals.

    No group is gathered in a task: see :func:`corvina.operators.selection.nearest_ranks`.
    """
    r2 = lambda c: js_round(c, 2)
    pct = nearest_ranks(rows, keys, value, {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    agg = rows.groupBy(*keys).agg(F.count(value).alias("count"), r2(F.min(value)).alias("min_ms"), r2(F.max(value)).alias("max_ms"), r2(F.avg(value)).alias("mean_ms"))
    right = pct.select(*[F.col(k).alias(f"_{k}") for k in keys], "p50_ms", "p95_ms", "p99_ms")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return agg.join(right, on, "left").select(*keys, "count", "min_ms", *[r2(F.col(c)).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")], "max_ms", "mean_ms")


def stage_latency(rows: DataFrame, timings: str) -> DataFrame:
    """A map of stage timings: the latency summary of every key that ends in _ms."""
    exploded = rows.select(F.explode(timings).alias("stage", "ms")).filter(F.col("stage").endswith("_ms"))
    return latency(exploded, ["stage"], "ms")


def failure_category(message: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    out = F.when(low == "", "none")
    for name, _, words in FAILURES:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, name)
    return out.otherwise("unknown")


def failure_retryable(message: Column) -> Column:
    final = [name for name, retry, _ in FAILURES if not retry]
    return ~failure_category(message).isin([*final, "none"])


def run_summary(jobs: DataFrame) -> DataFrame:
    """jobs(run_id, status): counts, state, progress."""
    n = lambda s: F.count_if(F.col("status") == s)
    agg = jobs.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_jobs"), n("succeeded").alias("succeeded_jobs"), n("failed").alias("failed_jobs"))
    done = F.col("succeeded_jobs") + F.col("failed_jobs")
    active = F.col("total_jobs") - done
    state = F.when(active > 0, "running").when(F.col("failed_jobs") > 0, "failed").otherwise("succeeded")
    return agg.select("*", done.alias("completed_jobs"), active.alias("active_jobs"), state.alias("state"), (done / F.col("total_jobs")).alias("progress"), (active == 0).alias("done"))


def counts_by(rows: DataFrame, keys: list[str], column: str, empty: str = "unknown") -> DataFrame:
    """Per key a count of every value of a column, nulls and empty strings as ``empty``."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(empty)).alias("value")
    return rows.select(*keys, value).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def source_sets(files: DataFrame) -> DataFrame:
    """files(domain, status, mime, bytes, updated_at) per domain, with counts by status and by mime as maps."""
    total = files.groupBy("domain").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_bytes"), F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.count_if(F.col("status") == "pending").alias("pending_count"), F.count_if(F.col("status") == "indexing").alias("indexing_count"),
        F.max("updated_at").alias("updated_at"),
    )
    as_map = lambda name, c: counts_by(files, ["domain"], c).groupBy("domain").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(name))
    return (
        total.withColumn("attention_count", F.col("failed_count") + F.col("pending_count"))
        .join(as_map("by_status", "status"), "domain")
        .join(as_map("by_mime", "mime"), "domain")
    )


def corpus_status(sources: list[DataFrame], files: DataFrame, jobs: DataFrame, drafts: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every domain any source knows, its conditional counts and state; one aggregation per table, no correlated subquery."""
    domains = sources[0].select("domain")
    for s in sources[1:]:
        domains = domains.union(s.select("domain"))
    n = lambda s: F.count_if(F.col("status") == s)
    f = files.groupBy("domain").agg(F.count(F.lit(1)).alias("files"), n("ready").alias("ready_files"), n("failed").alias("failed_files"), n("pending").alias("pending_files"))
    j = jobs.groupBy("domain").agg(F.count_if(F.col("status").isin("queued", "running")).alias("active_jobs"), n("failed").alias("failed_jobs"))
    d = drafts.groupBy("domain").agg(n("pending").alias("pending_drafts"))
    s = schemas.groupBy("domain").agg(F.count_if("is_active").alias("active_schemas"))
    out = domains.distinct()
    for t in (f, j, d, s):
        out = out.join(t, "domain", "left")
    out = out.na.fill(0)
    state = (
        F.when((F.col("failed_files") > 0) | (F.col("failed_jobs") > 0), "failed")
        .when(F.col("active_jobs") > 0, "ingesting")
        .when((F.col("files") > 0) & (F.col("ready_files") == F.col("files")), "ready")
        .when(F.col("files") > 0, "files_staged")
        .when(F.col("pending_drafts") > 0, "schema_draft")
        .when(F.col("active_schemas") > 0, "schema_ready")
        .otherwise("no_schema")
    )
    return out.withColumn("state", state)


def trace_export(traces: DataFrame) -> DataFrame:
    """traces(route, latency_ms, n_citations) per route, average over non-null latencies."""
    return traces.groupBy("route").agg(
        F.count(F.lit(1)).alias("traces"), js_round(F.avg("latency_ms"), 2).alias("avg_latency_ms"), F.sum("n_citations").alias("citations")
    )


def trace_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two traces (key, retrieved ids): shared, added and removed ids."""
    both = a.select("key", F.col("ids").alias("x")).join(b.select("key", F.col("ids").alias("y")), "key")
    size = lambda f, p, q: F.size(f(p, q)).cast("long")
    return both.select("key", size(F.array_intersect, "x", "y").alias("overlap"), size(F.array_except, "y", "x").alias("added"), size(F.array_except, "x", "y").alias("removed"))


def eval_rollup(reports: DataFrame, metrics: list[str]) -> DataFrame:
    """reports(kind, domain, created_at, report_id, metrics): count, latest report, 4-decimal averages of numeric values."""
    return reports.groupBy("kind", "domain").agg(
        F.count(F.lit(1)).alias("reports"), F.max_by("report_id", F.struct("created_at", "report_id")).alias("latest_report"),
        *[js_round(F.avg(m), 4).alias(f"avg_{m}") for m in metrics],
    )


def search_eval(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results(qid, chunk_id, rank), expected(qid, chunk_id): hit rate and mean reciprocal rank over all cases."""
    first = results.join(expected, ["qid", "chunk_id"]).groupBy("qid").agg(F.min("rank").alias("first"))
    cases = expected.select("qid").distinct().join(first, "qid", "left")
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.count("first").alias("hits"), F.avg(F.col("first").isNotNull().cast("int")).alias("hit_rate"),
                     F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def grade_rank(value: Column, limits: list[float], smaller_is_better: bool = True) -> Column:
    """0 for S, 1 for A+, 2 for A, else 3 (B) within twice the last limit, 4 (C) beyond."""
    ok = (lambda x: value <= x) if smaller_is_better else (lambda x: value >= x)
    out = F.when(ok(limits[0]), 0)
    for k, x in enumerate(limits[1:], 1):
        out = out.when(ok(x), k)
    last = 2 * limits[-1] if smaller_is_better else limits[-1] / 2
    return out.when(ok(last), len(limits)).otherwise(len(limits) + 1)


def grade(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in GRADES]), rank.cast("int") + 1)


def latest_per_group(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def tail(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The last entries of each group, oldest first in the array. Only those leave their tasks' windows."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    kept = rows.select(key, *order).withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= most)
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("history"))


def citation_f1(rows: DataFrame) -> DataFrame:
    """rows(id, got array, want array): precision, recall, F1."""
    hit = F.size(F.array_intersect("got", "want"))
    p = F.when(F.size("got") > 0, hit / F.size("got")).otherwise(0.0)
    r = F.when(F.size("want") > 0, hit / F.size("want")).otherwise(0.0)
    return rows.select("id", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def passage_hits(passages: DataFrame, texts: DataFrame, block: int = 1000) -> DataFrame:
    """passages(id, passage), texts(text), both in lower case: id, and whether any text holds the whole passage.

    Passages and texts meet on the passage's longest inner token, which any text that holds it has too. Passages
    of fewer than three tokens have no inner one; they are compared in blocks of a counted size.
    """
    inner = lambda c: F.slice(tokens(c), 2, F.greatest(F.size(tokens(c)) - 2, F.lit(0)))
    keyed = passages.withColumn("k", F.array_max(F.transform(inner(F.col("passage")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    by_token = texts.select("text", F.explode(F.array_distinct(tokens(F.col("text")))).alias("k"))
    hit = by_token.join(keyed.filter("k is not null"), "k").filter(F.col("text").contains(F.col("passage"))).select("id")
    short = keyed.filter("k is null").select("id", "passage")
    blocks = -(-short.count() // block)
    for n in range(blocks):
        some = short.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n)
        hit = hit.unionByName(texts.join(F.broadcast(some), F.col("text").contains(F.col("passage"))).select("id"))
    return passages.join(hit.distinct().withColumn("hit", F.lit(True)), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("hit"))


def query_eval(cases: DataFrame) -> DataFrame:
    """One row of rates over answered cases(id, hit, answer, citation_count, evidence, latency_ms, judged): hits, citations, faithfulness, judge.

    An answer is cited if it has citations and points at one; its faithfulness is the share of its words that the evidence
    has. judged(status, score) is the model's verdict where one was asked for, else null.
    """
    quality = F.when(F.col("citation_count") >= 0, support(F.col("answer"), F.col("evidence"), F.col("citation_count")))
    rows = cases.withColumn("s", quality).withColumn("cited", (F.col("citation_count") > 0) & F.col("answer").rlike(r"\[\d+\]"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    missing = F.col("s.answer_tokens") - F.col("s.supported_tokens")
    return rows.agg(
        F.count(F.lit(1)).alias("cases"), share(F.col("hit")).alias("hit_rate"), share(F.col("cited")).alias("citation_rate"), share(F.col("s.status") == "supported").alias("faithfulness_rate"),
        F.avg("s.coverage").alias("avg_faithfulness"), F.avg(missing).alias("avg_unsupported_tokens"), F.count("judged").alias("judged"),
        F.coalesce(F.try_divide(F.count_if(F.col("judged.status") == "supported"), F.count("judged")), F.lit(0.0)).alias("judge_support_rate"), F.avg("judged.score").alias("avg_judge_score"),
    )


def benchmark(samples: DataFrame) -> DataFrame:
    """samples(run, client_ms, server_ms, cache, warmup) per run: counts, both latencies, and how often a cache answered. Warm-up passes don't count."""
    real = samples.filter(~F.coalesce("warmup", F.lit(False)))
    hits = real.groupBy("run").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("cache") == "hit").alias("cache_hits"))
    out = hits.withColumn("cache_hit_rate", F.col("cache_hits") / F.col("samples"))
    for side in ("client", "server"):
        of = latency(real, ["run"], f"{side}_ms")
        out = out.join(of.select("run", *[F.col(c).alias(f"{side}_{c}") for c in ("p50_ms", "p95_ms", "p99_ms", "max_ms", "mean_ms")]), "run")
    return out
