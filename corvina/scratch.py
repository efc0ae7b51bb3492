"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of each application that are still there.
_WRITTEN: dict[str, set[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, remembered until it is dropped or :func:`clear` is called."""
    path = f"{_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def _root(spark: SparkSession) -> str:
    """The shared folder.

    The cluster names it in spark.checkpoint.dir. Where that is unset, a folder beside the warehouse is taken on one
    machine; a cluster without the setting is an error, since its executors would not see one another's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file:///tmp/corvina-scratch-{os.getuid()}"
    return root


def written(df: DataFrame, name: str, codec: str = "zstd", one_group: bool = False, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, lost executors cost nothing.

    one_group: a file is one row group of at most 1 GiB, so that no reader splits it. by: a column whose values get a
    folder each; a filter on it then decides which files are opened.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", codec)
    writer = writer.option("parquet.block.size", 1 << 30) if one_group else writer
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame | None) -> None:
    """Delete the files behind frames made by :func:`written` (or by selections from one) once nothing reads them any more."""
    for df in frames:
        if df is None:
            continue
        mine = _WRITTEN.get(df.sparkSession.sparkContext.applicationId, set())
        for folder in {re.sub(r"(/[^/=]+=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)
            mine -= {p for p in mine if p.rsplit("/", 1)[-1] == folder.rsplit("/", 1)[-1]}


def clear(spark: SparkSession) -> None:
    """Delete what this application has written and not dropped: the end of a job or a notebook session."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, set()):
        _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
