"""The control surface as table operations: bulk actions, schema drafts, retries, inventories and report merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.text import js_round, normalize_text, quality_tokens, tokens

#: Bulk actions on the files of a source set, by verb and the statuses they may name.
ACTIONS = {"requeue": ["all", "failed", "pending"], "archive": ["all", "failed", "ready"], "delete": ["all", "failed", "pending", "ready"]}
#: Words that tell the intent of a question, in order of precedence.
INTENTS = {
    "compare": r"\b(?:compare|compared|versus|vs|difference|differ)\b",
    "aggregate": r"\b(?:how many|count|total|sum|average|mean|most|least|highest|lowest|top)\b",
    "negative": r"\b(?:not|never|without|except|exclude|excluding|none)\b",
}
#: File types that only an external converter reads.
IMAGE_LIKE = r"(?i)\.(?:png|jpe?g|webp|gif|bmp|tiff?|heic|svg|ods|odt|odp|numbers|xls|xlsm|xlsb)$"


def _action(action: str) -> tuple[str, str]:
    verb, _, scope = action.strip().partition("_")
    if scope not in ACTIONS.get(verb, []):
        raise ValueError(f"unsupported source-set action {action!r}")
    return verb, scope


def affected(files: DataFrame, domain: str, action: str) -> DataFrame:
    """The files of a domain that a bulk action takes: those of the status it names. This is its dry run."""
    _, scope = _action(action)
    mine = files.filter(F.col("domain") == domain)
    return mine if scope == "all" else mine.filter(F.col("status") == scope)


def apply_action(files: DataFrame, domain: str, action: str) -> tuple[DataFrame, DataFrame]:
    """(files after the action, queued jobs): statuses are rewritten in one projection, deletion is a filter."""
    verb, scope = _action(action)
    hit = (F.col("domain") == domain) & (F.lit(True) if scope == "all" else F.col("status") == scope)
    hit = F.coalesce(hit, F.lit(False))
    jobs = affected(files, domain, action).select("file_id", "domain", F.lit("queued").alias("status"), F.lit("parse").alias("stage"), F.lit(0).alias("attempts"))
    if verb == "delete":
        return files.filter(~hit), jobs.limit(0)
    status = F.when(hit, "pending" if verb == "requeue" else "archived").otherwise(F.col("status"))
    return files.withColumn("status", status), jobs if verb == "requeue" else jobs.limit(0)


def draft_states(events: DataFrame) -> DataFrame:
    """events(draft_id, domain, action apply|discard, at): what became of every request, and the draft's status after it.

    A draft is pending, then applied or discarded; a discarded one can't be applied any more, an applied one can
    be applied again (each time as a new version) or discarded.
    """
    before = Window.partitionBy("draft_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max((F.col("action") == "discard").cast("int")).over(before), F.lit(0)) == 1
    accepted = ~((F.col("action") == "apply") & gone)
    return events.withColumn("accepted", accepted).withColumn("status", F.when(F.col("action") == "discard", "discarded").when(accepted, "applied").otherwise("discarded"))


def schema_versions(events: DataFrame) -> DataFrame:
    """domain, draft_id, version, is_active of every accepted application; the newest of a domain is active."""
    applied = draft_states(events).filter("accepted and action = 'apply'")
    order = Window.partitionBy("domain").orderBy("at", "draft_id")
    numbered = applied.withColumn("version", F.row_number().over(order))
    newest = F.max("version").over(Window.partitionBy("domain"))
    return numbered.select("domain", "draft_id", "version", (F.col("version") == newest).cast("int").alias("is_active"))


def retry_plan(jobs: DataFrame, most: int = 3) -> DataFrame:
    """jobs(status, attempts, valid) with what the consumer does: ack, retry after a delay, or dead letter."""
    failed = F.col("status") == "failed"
    action = F.when(~F.col("valid"), "ack_invalid").when(~failed, "ack").when(F.col("attempts") >= most, "dead_letter").otherwise("retry")
    return jobs.withColumn("decision", action).withColumn("delay_s", F.when(action == "retry", F.least(F.lit(300), 10 * F.greatest(F.lit(1), F.col("attempts")))))


def event_rows(jobs: DataFrame) -> DataFrame:
    """jobs(job_id, stages array, ok) as the rows of their event stream: started, one per stage, then answer or error."""
    stages = F.transform("stages", lambda s: F.struct(F.lit("stage").alias("event"), s.alias("detail")))
    ends = F.array(F.struct(F.when(F.col("ok"), "answer").otherwise("error").alias("event"), F.lit(None).cast("string").alias("detail")))
    begin = F.array(F.struct(F.lit("started").alias("event"), F.lit(None).cast("string").alias("detail")))
    return jobs.select("job_id", F.posexplode(F.concat(begin, stages, ends)).alias("seq", "e")).select("job_id", "seq", "e.event", "e.detail")


def inventory(files: DataFrame, jobs: DataFrame, traces: DataFrame) -> DataFrame:
    """One row of operator totals: counts, bytes, and maps of counts by status and stage."""

    def by(df: DataFrame, key: str, name: str) -> DataFrame:
        counts = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    rows = [
        files.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("file_bytes"), F.countDistinct("domain").alias("domain_count")),
        by(files, "status", "files_by_status"),
        jobs.agg(F.count(F.lit(1)).alias("job_count"), F.count_if(F.col("status").isin("queued", "running")).alias("active_jobs"), F.count_if(F.col("status") == "failed").alias("failed_jobs")),
        by(jobs, "status", "jobs_by_status"),
        by(jobs, "stage", "jobs_by_stage"),
        traces.agg(F.count(F.lit(1)).alias("trace_count"), js_round(F.avg("latency_ms"), 2).alias("avg_trace_latency_ms")),
    ]
    out = rows[0]
    for one in rows[1:]:  # each is one row
        out = out.join(F.broadcast(one))
    return out


def merge_parse_reports(reports: DataFrame) -> DataFrame:
    """reports(report_id, rows array<struct<ok,...>>, parser_counts map) merged into one row."""
    rows = reports.agg(
        F.count(F.lit(1)).alias("batches"), F.sum(F.size("rows")).alias("n"), F.sum(F.size(F.filter("rows", lambda r: F.coalesce(r["ok"], F.lit(False))))).alias("passed"),
        F.array_sort(F.collect_list("report_id")).alias("report_ids"),
    )
    parsers = reports.select(F.explode("parser_counts").alias("parser", "k")).groupBy("parser").agg(F.sum("k").alias("k"))
    merged = parsers.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parser", "k")))).alias("parser_counts"))
    return rows.join(F.broadcast(merged)).withColumn("pass_rate", F.try_divide("passed", "n"))


def merge_parses(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two parses (key, text, documents, page_count, record_count) of each file as one: distinct texts, all documents."""
    a, b = first.alias("a"), second.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    texts = F.filter(F.array_distinct(F.transform(F.array(F.coalesce("a.text", F.lit("")), F.coalesce("b.text", F.lit(""))), normalize_text)), lambda x: x != "")
    empty = F.array().cast(dict(first.dtypes)["documents"])
    count = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key), normalize_text(F.array_join(texts, "\n\n")).alias("text"),
        F.concat(F.coalesce("a.documents", empty), F.coalesce("b.documents", empty)).alias("documents"),
        F.greatest(count("a.page_count"), count("b.page_count")).alias("page_count"), (count("a.record_count") + count("b.record_count")).alias("record_count"),
    )


def conversion_wanted(mode: Column, name: Column, documents: Column, text: Column) -> Column:
    """Whether a file goes to the external converter, by policy: always, never, or where the local parse found too little."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.when(mode == "always", True).when(mode == "auto", name.rlike(IMAGE_LIKE) | (F.coalesce(documents, F.lit(0)) == 0) | (words < 8)).otherwise(False)


def citation_overlap(rows: DataFrame) -> DataFrame:
    """rows(id, index, answer, excerpt): shared tokens of an answer with each of its citations, as a count and a 3-decimal ratio."""
    answer = quality_tokens(F.col("answer"))
    overlap = F.array_intersect(answer, tokens(F.col("excerpt")))
    ratio = F.when(F.size(answer) > 0, js_round(F.size(overlap) / F.size(answer), 3))
    return rows.select("id", "index", F.length("excerpt").alias("excerpt_length"), F.size(overlap).alias("overlap"), ratio.alias("ratio"), overlap.alias("tokens"))


def trace_route(confidence: Column, filters: Column) -> Column:
    """The route of a trace: its confidence's, else its filters' (JSON texts; only strings count), else unknown."""
    of = lambda c: F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), "$.route", "variant")) == "STRING", F.try_variant_get(F.try_parse_json(c), "$.route", "string"))
    return F.coalesce(of(confidence), of(filters), F.lit("unknown"))


def timing_stages(traces: DataFrame) -> DataFrame:
    """traces(id, route, timing map, results, citations, answer): a row per ``*_ms`` stage, or one row without any, with diagnostics."""
    kept = F.filter(F.map_entries("timing"), lambda e: e["key"].endswith("_ms") & (e["key"] != "total_ms") & e["value"].isNotNull())
    stages = F.transform(kept, lambda e: F.struct(F.substring(e["key"], F.lit(1), F.length(e["key"]) - 3).alias("stage"), e["value"].alias("latency_ms")))
    none = F.array(F.struct(F.lit("answer").alias("stage"), F.lit(None).cast("double").alias("latency_ms")))
    full = F.when(F.size(kept) > 0, stages).otherwise(none)
    status = F.when(F.col("results") == 0, "empty_results").otherwise("has_results")
    return traces.select("id", "route", F.explode(full).alias("s"), "results", "citations", (F.trim(F.coalesce("answer", F.lit(""))) != "").alias("answer_present"), status.alias("status")).select("id", "route", "s.*", "results", "citations", "answer_present", "status")


def intent(question: Column) -> Column:
    """The intent of a question by its words."""
    out = F.when(F.lit(False), "")
    for name, pattern in INTENTS.items():
        out = out.when(F.lower(question).rlike(pattern), name)
    return out.otherwise("lookup")


def entity_results(entities: DataFrame, order: list[Column], k: int = 100) -> DataFrame:
    """The first k entities as search results: content is the JSON of their fields, the score falls with the rank.

    Every task keeps its own first k, so the ranking runs over a few rows.
    """
    ranked = entities.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.select(F.col("entity_id").alias("document_id"), F.to_json("fields").alias("content"), (1 / F.col("rank")).alias("score"), "rank")


def live(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Cache rows that have not expired."""
    return rows.filter(F.col(expires) > now)
