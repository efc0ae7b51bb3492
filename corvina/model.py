"""Adapters from the star-schema test tables to the engine's document, entity and telemetry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators.chunking import chunk_documents
from corvina.operators.lexical import Index
from corvina.operators.lexical import index as lexical_index
from corvina.session import share_code


#: Indexes of this session by folder, kind and state of the documents table.
_INDEXES: dict[tuple, Index] = {}


class Tables:
    """Lazy table access under one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        share_code(spark)
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def docs(self) -> DataFrame:
        return self.documents.select(
            F.lit("t0").alias("tenant"), F.col("lang").alias("index_id"), F.col("source").alias("domain"), F.col("doc_id").cast("string").alias("external_id"),
            "doc_id", F.col("text").alias("content"),
        )

    def chunks(self) -> DataFrame:
        return chunk_documents(self.docs())

    def small_chunks(self) -> DataFrame:
        """Documents as single chunks keyed by their own id: what the ranking queries run over."""
        return self.documents.select(
            F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"),
            F.col("doc_id").cast("int").alias("chunk_index"), F.col("text").alias("content"),
        )

    def index(self, kind: str = "small_chunks") -> Index:
        """The lexical index of ``small_chunks`` or ``chunks``: built once, and again when the documents' files change."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/documents.parquet")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        listed = files.listStatus(path)
        state = tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in listed))
        key = (self.spark.sparkContext.applicationId, kind, state)
        if key not in _INDEXES:
            _INDEXES[key] = lexical_index(getattr(self, kind)())
        return _INDEXES[key]

    def files(self) -> DataFrame:
        """documents with labels: quality 1 is ready, 0 failed, none pending."""
        status = F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "failed").otherwise("pending")
        mime = F.when(F.expr("cast(substr(source, 4) as int) % 3 = 0"), "").when(F.expr("cast(substr(source, 4) as int) % 3 = 1"), "text/plain").otherwise("text/html")
        return self.documents.join(self.labels, "doc_id", "left").select(
            "doc_id", F.col("source").alias("domain"), status.alias("status"), mime.alias("mime"), F.octet_length("text").cast("long").alias("bytes"), F.col("n_chars").alias("updated_at"), "text"
        )

    def jobs(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
        return self.orders.select((F.col("o_custkey") % 50).alias("run_id"), F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderpriority").alias("stage"), "o_custkey")
