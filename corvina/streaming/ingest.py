"""Streaming ingest: content-hash replay protection, job rows with retries, and windowed telemetry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3
#: Folders that the stored keys are dealt into.
SHARDS = 16


def retry_delay(attempts: int) -> int:
    """Seconds before the next attempt."""
    return min(300, 10 * max(1, attempts))


def ingest_stream(source: DataFrame, state_path: str, process: Callable[[DataFrame], DataFrame], key: str = "content_hash"):
    """A writer whose batches skip hashes that earlier batches stored and append the processed rest.

    Stored rows are an append-only Parquet table: a replayed batch finds its own rows and adds nothing. It is
    laid out by the key's shard, so a batch reads the keys of its own shards only. Of rows with one key in a batch
    the least stays, in every run.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        rest = [c for c in df.columns if c != key]
        fresh = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*").withColumn("shard", F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int"))
        done = _stored(spark, state_path, df)
        if done is not None:
            fresh = fresh.join(done.select(key, "shard"), ["shard", key], "left_anti")
        out = process(fresh.drop("shard")).withColumn("epoch", F.lit(epoch)).withColumn("shard", F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int"))
        out.repartition("shard").write.mode("append").partitionBy("shard").parquet(state_path)

    return source.writeStream.foreachBatch(batch).outputMode("append").trigger(availableNow=True)


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if exists else None


def job_rows(files: DataFrame, ok: str = "ok") -> DataFrame:
    """Processed files to job rows: stage, status and attempts of the ingest state machine."""
    failed = ~F.coalesce(F.col(ok), F.lit(False))
    return files.withColumn("status", F.when(failed, "failed").otherwise("succeeded")).withColumn("stage", F.when(failed, "parse").otherwise("indexed")).withColumn(
        "attempts", F.coalesce(F.col("attempts"), F.lit(0)) + failed.cast("int")
    )


def dead_letters(jobs: DataFrame) -> DataFrame:
    return jobs.filter((F.col("status") == "failed") & (F.col("attempts") >= MAX_ATTEMPTS))


def windowed(events: DataFrame, duration: str, late: str | None = None) -> DataFrame:
    """Extension: tumbling windows per type over an event table or stream (watermark for streams)."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    return rows.groupBy(F.window("ts", duration).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )
