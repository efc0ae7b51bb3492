"""Packing documents into fixed-length token sequences: first-fit decreasing on a tournament tree.

A document's ids (and an end id) are cut into whole sequences of ``length`` ids and one shorter rest.
Documents are dealt into randomised groups by a hash of their id and place; each group packs its rests on its own,
longest first, each into the first open bin with room. The open bins are the leaves of a tournament
tree whose inner nodes hold the largest free capacity below them, so the first fitting bin is found in
logarithmic time. Only (id, counts, checksums) reach the groups, never texts or ids.

Edge cases: null and empty texts are the end id alone; repeated rows are packed each on its own, dealt into
groups by their places in the scan; null ids form pieces with a null doc_id; texts of any length
are cut; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import bounded_batches, texts_of
from corvina.llm.units import worker_units

LENGTH, END = 1024, 0
#: Documents of a packing group: bounds a task's memory, far above what padding needs.
GROUP = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free capacities of bins in opening order; ``place`` finds the first that fits."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (max(bins, 1) - 1).bit_length())
        self.free = [capacity] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """(bin, offset inside it); bins not used yet are at full capacity, so one always fits."""
        free, k = self.free, 1
        while k < self.size:
            k *= 2
            if free[k] < need:
                k += 1
        at = free[k]
        free[k] -= need
        bin_, k = k - self.size, k // 2
        while k:
            best = max(free[2 * k], free[2 * k + 1])
            if free[k] == best:
                break
            free[k] = best
            k //= 2
        return bin_, at


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every item, in the order given."""
    tree = Tournament(len(lengths), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        bin_, free = tree.place(lengths[i])
        out[i] = bin_, capacity - free
    return out


def tokenised(docs: DataFrame, spec: str, length: int, end: int) -> DataFrame:
    """doc_id, place in the scan, n_tokens (end id included) and the checksum of each piece: whole sequences, then the rest."""
    spark = docs.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(spec)
    tail = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = worker_units(spec.value)
        for b in batches:
            counts, sums = [], []
            for raw in units.ids(texts_of(b.column(1))):
                ids = np.frombuffer(raw + tail, "<u2").astype("<u4")
                counts.append(len(ids))
                sums.append([zlib.crc32(ids[k : k + length]) for k in range(0, len(ids), length)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "place", "n_tokens", "sums"])

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    return placed.mapInArrow(run, "doc_id long, place long, n_tokens long, sums array<long>")


def pack(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, end: int = END, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    with open(tokenizer_file, encoding="utf-8") as f:
        counted = tokenised(docs, f.read(), length, end)
    groups = max(1, math.ceil(docs.count() / group))
    # A row's place in the scan spreads rows that are equal in all else; a scan that is tried again gives the same places.
    keyed = counted.withColumn("g", F.pmod(F.xxhash64("doc_id", "n_tokens", "place"), F.lit(groups))).drop("place")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        g = key[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        ids, counts, sums = table["doc_id"].to_pylist(), table["n_tokens"].to_pylist(), table["sums"].to_pylist()
        rests = [(i, n % length) for i, n in enumerate(counts) if n % length]
        placed = dict(zip((i for i, _ in rests), first_fit_decreasing([n for _, n in rests], length)))
        base, whole, rows = g << 32, 1 + max((b for b, _ in placed.values()), default=-1), []
        for i, n in enumerate(counts):
            for k, crc in enumerate(sums[i]):
                size = min(length, n - k * length)
                if size == length:
                    rows.append((ids[i], k * length, size, crc, n, base + whole, 0))
                    whole += 1
                else:
                    rows.append((ids[i], k * length, size, crc, n, base + placed[i][0], placed[i][1]))
        cols = list(zip(*rows)) or [[]] * 7
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return keyed.groupBy("g").applyInArrow(run, PIECES)
