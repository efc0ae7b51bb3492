"""Control-surface operators on small tables."""

import pytest
from pyspark.sql import functions as F

from corvina.operators import control


def test_bulk_actions(spark):
    files = spark.createDataFrame([(1, "a", "failed"), (2, "a", "ready"), (3, "b", "failed"), (4, "a", None), (5, None, "failed")], "file_id int, domain string, status string")
    assert [r.file_id for r in control.affected(files, "a", "delete_all").orderBy("file_id").collect()] == [1, 2, 4]
    after, jobs = control.apply_action(files, "a", "requeue_failed")
    assert {r.file_id: r.status for r in after.collect()} == {1: "pending", 2: "ready", 3: "failed", 4: None, 5: "failed"} and [r.file_id for r in jobs.collect()] == [1]
    after, jobs = control.apply_action(files, "a", "delete_ready")
    assert sorted(r.file_id for r in after.collect()) == [1, 3, 4, 5] and jobs.count() == 0
    assert control.apply_action(files, "a", "archive_ready")[0].filter("status = 'archived'").count() == 1
    for bad in ("archive_pending", "requeue", "drop_all", ""):
        with pytest.raises(ValueError):
            control.affected(files, "a", bad)


def test_drafts(spark):
    rows = [(1, "d", "apply", 1), (2, "d", "discard", 2), (2, "d", "apply", 3), (1, "d", "apply", 4), (3, "e", "apply", 5), (1, "d", "discard", 6)]
    events = spark.createDataFrame(rows, "draft_id int, domain string, action string, at int")
    got = {r.at: (r.accepted, r.status) for r in control.draft_states(events).collect()}
    assert got == {1: (True, "applied"), 2: (True, "discarded"), 3: (False, "discarded"), 4: (True, "applied"), 5: (True, "applied"), 6: (True, "discarded")}
    assert sorted((r.domain, r.draft_id, r.version, r.is_active) for r in control.schema_versions(events).collect()) == [("d", 1, 1, 0), ("d", 1, 2, 1), ("e", 3, 1, 1)]


def test_merged_parses(spark):
    kind = "f string, text string, documents array<string>, page_count int, record_count int"
    a = spark.createDataFrame([("x", "one  two", ["p"], 2, 1), ("y", "", [], 1, 0)], kind)
    b = spark.createDataFrame([("x", "one two", ["q"], 3, 4), ("z", "tail", ["r"], 1, 1)], kind)
    got = {r.f: tuple(r)[1:] for r in control.merge_parses(a, b, "f").collect()}
    assert got == {"x": ("one two", ["p", "q"], 3, 5), "y": ("", [], 1, 0), "z": ("tail", ["r"], 1, 1)}


def test_retries_events_and_routes(spark):
    jobs = spark.createDataFrame([(1, "failed", 0, True), (2, "failed", 40, True), (3, "failed", 3, True), (4, "queued", 0, False)], "id int, status string, attempts int, valid boolean")
    assert [(r.decision, r.delay_s) for r in control.retry_plan(jobs, 50).orderBy("id").collect()] == [("retry", 10), ("retry", 300), ("retry", 30), ("ack_invalid", None)]
    assert [(r.seq, r.event, r.detail) for r in control.event_rows(spark.createDataFrame([(1, [], False)], "job_id int, stages array<string>, ok boolean")).collect()] == [(0, "started", None), (1, "error", None)]
    t = spark.createDataFrame([('{"route": "a"}', None), ('{"route": 5}', '{"route": "b"}'), ("{", "[]"), (None, None)], "c string, f string")
    assert [r[0] for r in t.select(control.trace_route(F.col("c"), F.col("f"))).collect()] == ["a", "b", "unknown", "unknown"]
    assert [r[0] for r in spark.createDataFrame([("How many boats?",), ("a vs b: how many",), ("boats without sails",), ("boats",), (None,)], "q string").select(control.intent(F.col("q"))).collect()] == ["aggregate", "compare", "negative", "lookup", "lookup"]


def test_inventory_and_reports_of_empty_tables(spark):
    files = spark.createDataFrame([], "domain string, status string, bytes long")
    jobs = spark.createDataFrame([], "status string, stage string")
    one = control.inventory(files, jobs, spark.createDataFrame([], "latency_ms double")).first()
    assert one.file_count == one.job_count == one.file_bytes == 0 and one.files_by_status == {} and one.avg_trace_latency_ms is None
    reports = spark.createDataFrame([("r1", [(True,), (None,)], {"pdf": 1}), ("r2", [], {"pdf": 2, "html": 1})], "report_id string, rows array<struct<ok:boolean>>, parser_counts map<string,int>")
    r = control.merge_parse_reports(reports).first()
    assert (r.batches, r.n, r.passed, r.pass_rate, r.report_ids, r.parser_counts) == (2, 2, 1, 0.5, ["r1", "r2"], {"html": 1, "pdf": 3})
