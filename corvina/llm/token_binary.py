"""Token ids as a compact binary file: canonical length-limited Huffman codes in independent blocks.

File format: a folder of two Parquet tables. ``book`` has (id, length): code lengths, at most 16 bits,
from the exact global counts; canonical codes follow from them. ``blocks`` has one file per part, in folders
named in ascending document order (part=0000000, part=0000001, ...), with one row per block, in the same
order: the block's doc_ids and their id counts, ``first`` (ids of
the part before the block), ``payload`` (codes, most significant bit first) and ``marks``, the bit
offset of every 256th id. A block needs nothing but the book: any block, or any stretch from a mark,
decodes on its own, and stretches decode side by side through one table of 2^16 entries.

Parquet through Spark's committer keeps files whole when executors are lost, and any Hadoop file system
can hold them.

Edge cases: null and empty texts are the end id alone; repeated ids keep one entry per row, ordered by
text; null ids come first; an empty table writes a valid empty file; a document is never split over
blocks; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm.common import bounded_batches, drop_written, scratch, texts_of, written
from corvina.llm.units import worker_units

END = 2
MAX_BITS = 16
#: Ids of a block (a longer document makes a longer block), and ids between marks.
BLOCK, STEP = 1 << 18, 256
#: Bytes of text that a part aims at, and parts up to which their bounds are compared one by one.
PART_BYTES, MAX_BOUNDS = 24_000_000, 512
RAW = "part int, block int, first long, doc_ids array<long>, counts array<long>, ids binary"
BLOCKS = "part int, block int, first long, doc_ids array<long>, counts array<long>, n_ids long, marks array<long>, payload binary"
OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def limited_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits per symbol with a count (0: no code); package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    kinds = []  # per level: which entries of the sorted list are packages
    level = coins
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([coins, packages])
        rank = np.argsort(both, kind="stable")
        kinds.append(rank >= len(coins))
        level = both[rank]
    take = 2 * len(order) - 2
    for is_package in reversed(kinds):
        packages = int(is_package[:take].sum())
        lengths[order[: take - packages]] += 1
        take = 2 * packages
    lengths[order[:take]] += 1
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each one more than the last, shifted where the length grows."""
    codes = np.zeros(len(lengths), np.int64)
    code, last = 0, 0
    for s in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(payload, bit offsets of every STEP-th id)."""
    size = lengths[ids]
    ends = np.cumsum(size)
    begins = ends - size
    value = codes[ids] << (32 - (begins & 15) - size)  # two 16-bit words from the word a code begins in
    word = begins >> 4
    heads = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])  # codes have 16 bits at most: no word is skipped
    out = np.zeros(int(word[-1]) + 2, np.int64)
    out[:-1] += np.add.reduceat(value >> 16, heads)
    out[1:] += np.add.reduceat(value & 0xFFFF, heads)
    return out.astype(">u2").tobytes()[: (int(ends[-1]) + 7) // 8], begins[::STEP]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for every 16-bit window."""
    codes, symbol, size = canonical_codes(lengths), np.zeros(1 << MAX_BITS, np.int64), np.ones(1 << MAX_BITS, np.int64)
    for s in np.flatnonzero(lengths):
        n = MAX_BITS - int(lengths[s])
        symbol[codes[s] << n : (codes[s] + 1) << n], size[codes[s] << n : (codes[s] + 1) << n] = s, lengths[s]
    return symbol, size


def decode_block(payload: bytes, marks: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of a block: all stretches advance together, one id each per step."""
    symbol, size = table
    data = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.int64)
    windows = data[:-3] << 16 | data[1:-2] << 8 | data[2:-1]  # 24 bits from each byte
    at, last = marks.astype(np.int64), 8 * len(payload)
    out = np.zeros((STEP, len(at)), "<u4")
    for k in range(min(STEP, n)):
        window = windows[at >> 3] >> (8 - (at & 7)) & 0xFFFF
        out[k] = symbol[window]
        at = np.minimum(at + size[window], last)  # the last stretch may run past its end; cut below
    return out.T.reshape(-1)[:n]


def _in_ranges(docs: DataFrame, parts: int) -> DataFrame:
    """Documents in partitions of ascending ids. Up to MAX_BOUNDS of them, bounds come from the ids alone, so texts are read once."""
    if parts > MAX_BOUNDS:
        return docs.repartitionByRange(parts, "doc_id")
    bounds = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [1.0], 100_000)).first()[0] or []
    below = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<long>"), lambda b: b < F.col("doc_id")))
    return docs.repartitionById(max(1, len(set(bounds)) + 1), F.when(F.col("doc_id").isNull(), 0).otherwise(below))


def _bytes(docs: DataFrame) -> int:
    """About how many bytes of text the documents have: twice their files, else what the texts say."""
    jvm, conf = docs.sparkSession._jvm, docs.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in docs.inputFiles()]
    if paths:
        return 2 * sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def raw_blocks(docs: DataFrame, spec: str, end: int, parts: int) -> DataFrame:
    """Blocks of plain ids in document order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(spec)
    tail = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = worker_units(spec.value)
        part, block, first, size = 0, 0, 0, 0
        ids: list[bytes] = []
        keys: list[int | None] = []

        def flush() -> pa.RecordBatch:
            counts = [len(x) // 2 for x in ids]
            cols = [[part], [block], [first], [keys], [counts], [b"".join(ids)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["part", "block", "first", "doc_ids", "counts", "ids"])

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(2)[0].as_py()
            for key, raw in zip(b.column(0).to_pylist(), units.ids(texts_of(b.column(1)))):
                keys.append(key)
                ids.append(raw + tail)
                size += len(raw) // 2 + 1
                if size >= BLOCK:
                    yield flush()
                    block, first, size = block + 1, first + size, 0
                    ids, keys = [], []
        if ids:
            yield flush()

    ranged = _in_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), parts)
    return ranged.sortWithinPartitions("doc_id", "text").select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, RAW)


def global_counts(raw: DataFrame) -> np.ndarray:
    """Exact number of times each id occurs; at most 65,536 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for r in raw.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def write(docs: DataFrame, path: str, tokenizer_file: str, end: int = END) -> None:
    """Tokenise, count, code and write."""
    spark = docs.sparkSession
    size = _bytes(docs)
    with open(tokenizer_file, encoding="utf-8") as f:
        raw = written(raw_blocks(docs, f.read(), end, max(1, -(-size // PART_BYTES))), "token-ids", one_group=True)
    lengths = limited_lengths(global_counts(raw))
    codes = canonical_codes(lengths)
    book = [(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, length int").coalesce(1).write.parquet(f"{path}/book")
    shared = spark.sparkContext.broadcast((codes, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = shared.value
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                ids = np.frombuffer(row.column(5)[0].as_buffer(), "<u2").astype(np.int64)
                payload, marks = encode_block(ids, codes, lengths)
                new = [pa.array([len(ids)], pa.int64()), pa.array([marks], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
                yield pa.RecordBatch.from_arrays(row.columns[:5] + new, ["part", "block", "first", "doc_ids", "counts", "n_ids", "marks", "payload"])

    # A raw file is one part and one row group, so one task codes it and writes the one file of its folder.
    named = raw.mapInArrow(run, BLOCKS).withColumn("part", F.lpad(F.col("part").cast("string"), 7, "0"))
    named.sortWithinPartitions("part", "block").write.partitionBy("part").option("compression", "none").parquet(f"{path}/blocks")
    drop_written(raw)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    lengths = np.zeros(1 << 16, np.int64)
    for r in spark.read.parquet(f"{path}/book").collect():  # at most 65,536
        lengths[r.id] = r.length
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("part", "block", "first", "doc_ids", "counts", "n_ids", "marks", "payload")
    sizes = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row per part
    bases, total = {}, 0
    for part in sorted(sizes):
        bases[part] = total
        total += sizes[part]
    shared = spark.sparkContext.broadcast((lengths, bases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, bases = shared.value
        table = decode_table(lengths)
        for b in batches:
            for k in range(b.num_rows):
                part, first, n = (b.column(c)[k].as_py() for c in (0, 2, 5))
                counts = np.array(b.column(4)[k].as_py(), np.int64)
                ids = decode_block(b.column(7)[k].as_py(), np.array(b.column(6)[k].as_py(), np.int64), n, table)
                cuts = np.concatenate([[0], np.cumsum(counts)])
                sums = [zlib.crc32(ids[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.column(3)[k].as_py(), pa.int64()), pa.array(cuts[:-1] + bases[part] + first, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.mapInArrow(run, OUT)


def round_trip(docs: DataFrame, tokenizer_file: str, end: int = END) -> DataFrame:
    """Write to a fresh folder of the shared scratch space, then read it back."""
    path = scratch(docs.sparkSession, "token-file")
    write(docs, path, tokenizer_file, end)
    return read(docs.sparkSession, path)
