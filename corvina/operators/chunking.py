"""Chunking, content-addressed identity and chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.text import collapse, deterministic_id

SIZE, OVERLAP = 2000, 200


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks of one paragraph, in closed form: the last window is the first to leave at most ``overlap``."""
    step, n = size - overlap, F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    )


def packed(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Paragraph packing as a fold: the separator is not counted, oversize paragraphs become windows."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(a: Column, p: Column) -> Column:
        joined = F.concat(a["cur"], F.when(a["cur"] == "", "").otherwise("\n\n"), p)
        flushed = F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"])))
        fits = F.length(a["cur"]) + F.length(p) <= size
        over = F.length(p) > size
        done = F.when(fits, a["done"]).when(over, F.concat(flushed, windows(p, size, overlap))).otherwise(flushed)
        return F.struct(done.alias("done"), F.when(fits, joined).when(over, "").otherwise(p).alias("cur"))

    return F.aggregate(F.split(text, "\n\n"), start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, general: bool = False) -> DataFrame:
    """documents(tenant, index_id, external_id, content) to chunks with deterministic ids.

    ``general`` folds over paragraphs; without it the text must be one paragraph (no blank line), where the
    closed form is exact and far cheaper.
    """
    size, overlap = max(100, min(size, 8000)), max(0, min(overlap, max(100, min(size, 8000)) - 1))
    content = F.regexp_replace("content", r"^\s+|\s+$", "")
    scope = F.concat_ws(":", "tenant", "index_id", "external_id")
    parts = docs.select(
        "tenant", "index_id", "external_id", deterministic_id("doc_", F.concat(F.lit("doc:"), scope)).alias("document_id"), scope.alias("scope"),
        F.posexplode(packed(content, size, overlap) if general else windows(content, size, overlap)).alias("chunk_index", "content"),
    )
    return parts.select(
        "tenant", "index_id", "external_id", "document_id", "chunk_index",
        deterministic_id("chk_", F.concat(F.lit("chk:"), F.col("scope"), F.lit(":"), F.col("chunk_index").cast("string"), F.lit(":chunk"))).alias("chunk_id"), "content",
    )


def previews(chunks: DataFrame, most: int = 3, chars: int = 240) -> DataFrame:
    """The first chunks of each document, shortened."""
    return chunks.filter(F.col("chunk_index") < most).select("document_id", "chunk_index", F.substring("content", 1, chars).alias("preview"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key: incoming rows win."""
    return incoming.unionByName(existing.join(incoming.select(*keys).distinct(), keys, "left_anti"))


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or ignore by key: existing rows win."""
    return existing.unionByName(incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def register_files(files: DataFrame) -> DataFrame:
    """files(project, domain, file_id, text) to one row per content hash: the least id owns it, the rest are replays."""
    hashed = files.withColumn("content_hash", F.sha2("text", 256))
    return hashed.groupBy("project", "domain", "content_hash").agg(
        F.min("file_id").alias("file_id"), F.max(F.octet_length("text")).alias("bytes"), (F.count(F.lit(1)) - 1).alias("replays")
    )


def dedupe_chunks(chunks: DataFrame, id_col: str, file_col: str, prefix: str = "chunk:") -> DataFrame:
    """One row per normalised chunk hash with the other files that hold it."""
    hashed = chunks.withColumn("content_hash", F.sha2(F.concat(F.lit(prefix), F.lower(collapse("content"))), 256))
    agg = hashed.groupBy("content_hash").agg(F.min(id_col).alias(id_col), F.min(file_col).alias(file_col), F.array_sort(F.collect_set(file_col)).alias("files"))
    return agg.select("content_hash", id_col, file_col, F.array_remove("files", F.col(file_col)).alias("also_in_files"))


def delete_cascade(removed: DataFrame, tables: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Every table without the rows of removed keys."""
    return {name: t.join(removed.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def validate_vectors(rows: DataFrame, dimensions: int, vector_col: str = "embedding") -> DataFrame:
    """Rows with a ``problem``: wrong_dimensions, not_finite or null."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.withColumn("problem", F.when(v.isNull() | (F.size(v) != dimensions), "wrong_dimensions").when(bad, "not_finite"))


def running_index(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Zero-based running chunk_index inside each group."""
    return rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
