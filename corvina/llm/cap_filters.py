"""Embedding near-dedup by spherical-cap filters from structured random product codes.

A filter is a direction; a vector passes if its inner product with it reaches a threshold. Directions
are concatenations of one random code word per part of the coordinates, after one of a few random
rotations, so a vector is list-decoded to all filters it passes from the per-part products alone: only words
that can still reach the threshold with the best word of the other part are combined. Similar vectors
pass a common filter with high probability; vectors are joined on filters and compared exactly (cosine
in double precision).

The number of words and the threshold follow from the dimension, the number of vectors and the cosine:
a cap takes in about BUCKET random vectors, but is never so narrow that a pair at the cosine would seldom
share it, and there are enough caps for a pair exactly at the cosine to be missed with a probability of
about MISS (a pair above it far more seldom). Links are therefore complete up to that share.

Nodes are distinct vectors with their multiplicity, so copies never meet in a bucket. Only (bucket, node)
keys are exploded; buckets of one node are dropped before vectors join their keys. A large bucket is dealt
into blocks of bounded size; each pair of blocks is compared by one matrix product, with link counts per node
and a spanning star per local component, never the pairs themselves. A pair that shares several
filters is counted at the least of them.

Edge cases: null, empty and zero vectors, and vectors with null or non-finite components, link with
nothing; vectors of another length than most are compared among their own length only; repeated rows
(also with one vec_id) count as separate vectors; null ids have links but name no component; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import bounded_batches, drop_written, release, shuffled_joins, written
from corvina.llm.components import components

COSINE = 0.9
#: Rotations; share of pairs exactly at the cosine that may be missed; random vectors that a cap aims at; least
#: probability that a pair at the cosine shares a cap that one of the two is in.
ROTATIONS, MISS, BUCKET, SHARED, SEED = 8, 0.001, 256, 0.4, 2024
#: Vector bytes of a block of a bucket, and of the small buckets that one task call compares: both bound a task's matrices.
BLOCK_BYTES, CELL_BYTES = 1 << 20, 8 << 20


@lru_cache(maxsize=64)
def plan(dim: int, count: int, cosine: float) -> tuple[int, int, float]:
    """(parts, words per part, threshold) for a dimension and number of vectors."""
    d = max(dim, 2)
    angle = np.linspace(0, math.pi, 40_001)[1:-1]
    density = np.exp((d - 2) * np.log(np.sin(angle)))
    share = np.cumsum(density) / density.sum()  # of directions within an angle
    # Beside x, the other vector of a pair is a direction of the space across x.
    across = np.exp((d - 3) * np.log(np.sin(angle))) if d > 2 else None
    tail = (lambda t: np.interp(np.arccos(np.clip(t, -1, 1)), angle, np.cumsum(across) / across.sum(), 0, 1)) if d > 2 else (lambda t: ((t <= 1) + (t <= -1)) / 2)
    best = (0.0, 0.0, 0.0)
    for k in range(1, 70):
        p = 0.75**k
        cap = float(np.interp(p, share, angle))
        inside = angle <= cap
        u = np.cos(angle[inside])
        need = (math.cos(cap) - cosine * u) / (math.sqrt(max(1e-12, 1 - cosine * cosine)) * np.sin(angle[inside]))
        q = float((density[inside] * tail(need)).sum() / density[inside].sum()) if inside.any() else 0.0
        if q < SHARED and best[0]:
            break
        best = (p, q, math.cos(cap))
        if p * count <= BUCKET:
            break
    p, q, threshold = best
    # Caps of one code are not independent: as many again as independent ones would need.
    caps = 2 * math.log(MISS) / math.log(1 - min(max(q, 0.01), 0.99)) / p / ROTATIONS
    return (1, math.ceil(caps), threshold) if dim < 8 else (2, math.ceil(math.sqrt(caps)), threshold)


class Codes:
    """The product codes for one dimension; the same on every worker."""

    def __init__(self, dim: int, count: int, cosine: float, seed: int):
        parts, self.words, self.threshold = plan(dim, count, cosine)
        self.cuts = np.linspace(0, dim, parts + 1).astype(int)
        self.codes = []
        for k in range(ROTATIONS):
            rng = np.random.default_rng([seed, dim, k])
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            blocks = []
            for a, b in zip(self.cuts[:-1], self.cuts[1:]):
                w = rng.standard_normal((self.words, b - a))
                blocks.append(w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(parts))
            self.codes.append((turn, blocks))

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per row, ascending, every filter that its inner product with reaches the threshold.

        Each row also gets its best filter per rotation, so that no vector is left without one.
        """
        rows, filters = [], []
        for k, (turn, blocks) in enumerate(self.codes):
            turned = unit @ turn
            products = [turned[:, a:b] @ w.T for a, b, w in zip(self.cuts[:-1], self.cuts[1:], blocks)]
            base = k * self.words ** len(blocks)
            for at, found in self._combine(products):
                rows.append(at)
                filters.append(found + base)
        row, found = np.concatenate(rows), np.concatenate(filters)
        order = np.lexsort((found, row))
        row, found = row[order], found[order].astype(np.int32)
        cuts = np.searchsorted(row, np.arange(len(unit) + 1))
        return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _combine(self, products: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(products[0])
        if len(products) == 1:
            hit = products[0] >= self.threshold
            hit[np.arange(n), products[0].argmax(1)] = True
            yield np.nonzero(hit)
            return
        one, two = products
        # Words that can reach the threshold beside the other part's best word (and the best ones themselves).
        good = [int((x >= np.minimum(self.threshold - y.max(1), x.max(1))[:, None]).sum(1).max()) for x, y in ((one, two), (two, one))]
        i, j = (np.argsort(-x, axis=1, kind="stable")[:, :m] for x, m in zip(products, good))
        step = max(1, 4_000_000 // (good[0] * good[1]))
        for s in range(0, n, step):
            r = slice(s, s + step)
            total = np.take_along_axis(one[r], i[r], 1)[:, :, None] + np.take_along_axis(two[r], j[r], 1)[:, None, :]
            hit = total >= self.threshold
            hit[:, 0, 0] = True
            at, a, b = np.nonzero(hit)
            yield at + s, i[r][at, a] * self.words + j[r][at, b]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vector(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, np.float64 if wide else np.float32)


def _listed(nodes: DataFrame, count: int, cosine: float, seed: int) -> DataFrame:
    """node, n, dim, vector (its components in 4 bytes where that is exact, else 8) and filters (ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Codes] = {}
        for b in batches:
            lists = b.column(2)
            sizes = lists.value_lengths().to_numpy()
            flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
            vectors = [flat[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
            with np.errstate(over="ignore"):
                raw = [(w if (w == v).all() else v).tobytes() for v in vectors for w in (v.astype(np.float32),)]
            found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(vectors)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim).tolist()
                # Vectors of one component go by their sign.
                x = _unit(np.stack([np.append(vectors[k], 0.0) if dim == 1 else vectors[k] for k in at]))
                if dim not in codes:
                    codes[dim] = Codes(max(dim, 2), count, cosine, seed)
                for k, f in zip(at, codes[dim].decode(x)):
                    found[k] = f
            ends = np.cumsum([0, *map(len, found)])
            filters = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary()), filters], ["node", "n", "dim", "vector", "filters"])

    return nodes.mapInArrow(run, "node long, n long, dim int, vector binary, filters array<int>")


def _least_common(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Least common entry of paired rows of padded, ascending filter lists."""
    out = np.full(len(f), np.iinfo(np.int32).max)
    for k in range(f.shape[1]):
        same = (g == f[:, k : k + 1]).any(1) & (f[:, k] >= 0)
        out = np.where(same, np.minimum(out, f[:, k]), out)
    return out


def _compare(cosine: float):
    """A cell, which is one pair of blocks of one large bucket or many small buckets, to (node, n_links, root) rows."""

    def bucket(number: int, dim: int, nodes: np.ndarray, n: np.ndarray, side: np.ndarray, vectors: list[bytes], lists: list) -> tuple[np.ndarray, ...]:
        unit = _unit(np.stack([_vector(v, len(v) == 8 * dim).astype(np.float64) for v in vectors]))
        cut = int((side == side[0]).sum())
        left, right = np.arange(cut), np.arange(0 if cut == len(nodes) else cut, len(nodes))
        links, parent = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        padded = None
        for s in range(0, len(left), 512):
            rows = left[s : s + 512]
            a, b = np.nonzero(unit[rows] @ unit[right].T >= cosine)
            a, b = rows[a], right[b]
            once = a < b
            a, b = a[once], b[once]
            if not len(a):
                continue
            if padded is None:
                padded = np.full((len(lists), max(map(len, lists))), -1, np.int32)
                for k, f in enumerate(lists):
                    padded[k, : len(f)] = f
            for c in range(0, len(a), 50_000):
                x, y = a[c : c + 50_000], b[c : c + 50_000]
                first = _least_common(padded[x], padded[y]) == number
                np.add.at(links, x[first], n[y[first]])
                np.add.at(links, y[first], n[x[first]])
            parent = _merge(parent, a, b, nodes)
        used = (links > 0) | (parent != np.arange(len(nodes)))
        return nodes[used], links[used], nodes[parent[used]]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((table["block"].to_numpy(), table["bucket"].to_numpy(), table["dim"].to_numpy()))
        dims, numbers, nodes, n, side = (table[c].to_numpy()[order] for c in ("dim", "bucket", "node", "n", "block"))
        vectors, lists = table["vector"].to_pylist(), table["filters"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy()).tolist()
        filters = [flat[a:b] for a, b in zip([0, *ends], ends)]
        vectors, filters = [vectors[k] for k in order], [filters[k] for k in order]
        cuts = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (dims[1:] != dims[:-1])) + 1).tolist(), len(nodes)]
        found = [(np.zeros(0, np.int64),) * 3]
        for a, b in zip(cuts, cuts[1:]):
            found.append(bucket(int(numbers[a]), int(dims[a]), nodes[a:b], n[a:b], side[a:b], vectors[a:b], filters[a:b]))
        node, links, root = (np.concatenate(c) for c in zip(*found))
        return pa.table({"node": node, "n_links": links, "root": root})

    return run


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Least-node labels after joining a and b: labels fall along edges until they rest."""
    rank = np.argsort(np.argsort(nodes, kind="stable"), kind="stable")
    of = np.argsort(rank)
    label = rank[parent]
    if not len(a):
        return parent
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, of[label[a]], low)
        np.minimum.at(new, of[label[b]], low)
        new = np.minimum(new, new[of[new]])
        if (new == label).all():
            return of[new]
        label = new


def dedup(vectors: DataFrame, cosine: float = COSINE, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = F.coalesce(F.size("v") > 0, F.lit(False)) & F.expr(
        "forall(v, x -> x is not null and not isnan(x) and abs(x) < cast('infinity' as double)) and exists(v, x -> x <> 0)"
    )
    # -0.0 and 0.0 are one value; the hash stands for the vector in joins, the vector itself is compared too.
    rows = rows.withColumn("v", F.expr("transform(v, x -> if(x = 0, cast(0 as double), x))")).withColumn("ok", usable)
    rows = rows.withColumn("h", F.when(F.col("ok"), F.xxhash64("v")))
    with shuffled_joins(spark):
        # A node is named by its place in the table of distinct vectors: ids may be null or repeated.
        classes = rows.filter("ok").groupBy("h", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
        classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "vectors")
        listed = written(_listed(classes.select("node", "n", F.col("v").alias("vector")), classes.count(), cosine, seed), "filters")
        keys = listed.select("node", "dim", F.length("vector").alias("bytes"), F.explode("filters").alias("bucket"))
        sizes = keys.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes")).filter("size > 1")
        sizes = sizes.select("dim", "bucket", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks"))
        shared = written(keys.join(sizes, ["dim", "bucket"]).select("node", "dim", "bucket", "bytes", "blocks"), "keys")
        size = shared.agg(F.sum("bytes")).first()[0] or 0
        cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // CELL_BYTES)
        placed = (
            shared.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .withColumn("cell", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("dim", "bucket"), F.lit(cells))).otherwise(F.xxhash64("dim", "bucket")))
            .select("node", "bucket", "block", "blocks", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
            .join(listed, "node")
        )
        found = written(placed.groupBy("blocks", "cell", "i", "j").applyInArrow(_compare(cosine), "node long, n_links long, root long"), "links")
        drop_written(listed, shared)
        release(spark)
        degree = found.groupBy("node").agg(F.sum("n_links").alias("links"))
        stars = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        named = classes.join(degree, "node", "left").join(stars, "node", "left").select("h", "v", "least", "n", "links", F.coalesce("component", "node").alias("component"))
        heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
        result = named.join(heads, "component").select("h", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
        result = written(result, "result")
        drop_written(classes, found, stars)
    # Vectors that link with nothing stay out of the join: they would all meet in one task.
    linked = rows.filter("ok").join(result, ["h", "v"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
