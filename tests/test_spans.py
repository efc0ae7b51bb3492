"""The best span of odd texts, as the query's SQL has it."""

import duckdb

import __spark_entry__

ODD = [
    (1, "a was tion. b ing was tion! c"), (2, ""), (3, None), (4, " \n\t"), (5, "was\x0btion. x\x0b ing was"), (6, "\u00a0was tion. tion\u00a0"), (7, "\u3000was"), (8, "x\x01was tion. y\x01ing was tion"),
    (9, "wa\u0130 was. T\u0130ON \u0130NG"), (10, "y" * 416 + "\u00a0\u00a0  zzz was"), (11, "\x01"), (12, "\x0b"), (13, "a.\x0bwas. b tion"), (14, "was. " * 90), (15, "\u2003"), (16, "\u00e9 was. " + "no hit " * 80),
    (20, "alpha was"), (20, "alpha was"), (21, "none"), (21, "was ing here"), (22, None), (22, "ing was"), (None, "was"),
]


def test_best_span_of_odd_texts(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in __spark_entry__.queries()["best_evidence_span"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as db:
        db.execute(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = db.sql(__spark_entry__.oracle_sql()["best_evidence_span"]).fetchall()
    # No row for a text without sentences, one row an id.
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 15
