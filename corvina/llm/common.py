"""What the operators share: table loading, written tables and Arrow helpers."""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvina.scratch import drop_written, scratch, written
from corvina.session import share_code

__all__ = ["bounded_batches", "drop_written", "fresh_name", "load", "release", "scratch", "shuffled_joins", "texts_of", "written"]

#: Rows of an Arrow batch sent to Python; texts can be long, so batches stay small.
BATCH_ROWS = 512


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for executors whose rows hold whole documents."""
    share_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and broadcasts of finished jobs now: it does when the driver has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """Joins of the jobs inside move no table through the driver."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]
