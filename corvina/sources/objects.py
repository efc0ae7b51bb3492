"""Raw files and parse results, kept once per content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions.text import safe_key
from corvina.scratch import written


def object_key(project: Column, domain: Column, digest: Column, name: Column) -> Column:
    """Where a file's bytes lie."""
    return F.concat_ws("/", F.lit("raw"), safe_key(project), safe_key(domain), digest, safe_key(name))


def put(files: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """files(project, domain, filename, content) to the objects, written in a folder a domain, and a pointer a file.

    An object is there once for its project, domain and content hash, under the least file name that has it; objects that are
    stored already are not written again. Pointers (project, domain, filename, content_hash, object_key, bytes, new) say where each file is.
    """
    hashed = files.filter("content is not null").withColumn("content_hash", F.sha2("content", 256))
    key = ["project", "domain", "content_hash"]
    once = hashed.groupBy(*key).agg(F.min("filename").alias("owner"), F.first("content").alias("content"), F.max(F.octet_length("content")).cast("long").alias("bytes"))
    objects = once.withColumn("object_key", object_key(F.col("project"), F.col("domain"), F.col("content_hash"), F.col("owner"))).drop("owner")
    if stored is not None:
        have = stored.select(*key, F.col("object_key").alias("there"))
        objects = objects.join(have, key, "left").withColumn("object_key", F.coalesce("there", "object_key")).withColumn("new", F.col("there").isNull()).drop("there")
    else:
        objects = objects.withColumn("new", F.lit(True))
    objects = written(objects.hint("rebalance", "domain"), "objects", by="domain")
    pointers = hashed.select(*key, "filename").join(objects.select(*key, "object_key", "bytes", "new"), key)
    fresh = objects.filter("new").drop("new")
    return (fresh if stored is None else stored.unionByName(fresh)), pointers


def get(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """The bytes of keys(object_key); a key that isn't there has none."""
    return keys.join(objects.select("object_key", "content", "bytes"), "object_key", "left")
