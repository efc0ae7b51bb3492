"""Exact top-k by inner product over an impact-ordered index, a score at a time.

Rows are indexed in blocks. In a block each component is quantised to a multiple of the block's step, its impact, and
the rows with one impact in one dimension form a posting segment; a segment holds row numbers only, and segments
lie by descending size of the impact. A query adds impact times its own component to the accumulators of a
segment's rows. Beside the segments a block keeps, for up to ``STOPS`` places in that order, the length of what is
still missing from each row there: postings not read yet and the quantisation error of those read. By
Cauchy-Schwarz a row's score is at most its accumulator plus that length times the query's. A row whose bound is
below the query's k-th best exact score so far is proven out; reading stops once few enough rows are left, and those
are scored exactly from the stored integers. Without such a proof every segment is read.

The queries of a round are a broadcast of at most 2 * ``QUERIES`` rows (checked); each task keeps the best k rows of each
query over its blocks, and only those are shuffled. Nothing is sampled or capped.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; a component of 2**32 or more
in size counts as non-finite. Vectors of different lengths do not meet. A query's own row is that row alone: other rows with
its id are candidates, and each row with a divisible id is a query of its own. A null id is no query, and comes last
among ties. Scores that might leave a long raise an error, as sums do in ANSI mode. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import drop_written, written
from corvina.session import share_code

SCALE, LARGEST = 64, 2.0**32
#: Rows of a block, places where reading may stop, queries of a round and of one pass over a block.
BLOCK, STOPS, QUERIES, BATCH = 4096, 10, 16_384, 256
#: Reading stops when at most this share of rows is possible: scoring them costs no more than another part of the segments.
FEW = 1 / 32
#: Pairs that are scored at a time.
PAIRS = 1 << 16

INDEX = "dim int, block long, step long, ids array<long>, vectors binary, docs binary, dims array<int>, impacts array<int>, ends array<int>, stops array<int>, missing binary"


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and x, the components as integers floor(64 * c), of the rows that take part."""
    value = F.col(vector)
    fits = F.forall(value, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    x = F.transform(value, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return vectors.filter(F.coalesce((F.size(value) > 0) & fits, F.lit(False))).select(F.col(key).cast("long").alias("id"), x.alias("x"))


def _segments(x: np.ndarray) -> dict:
    """The posting segments of a block by descending impact, and the places where reading may stop."""
    rows, dim = x.shape
    step = max(1, round(float(np.sqrt((x.astype(float) ** 2).mean())) / 2))
    impact = np.sign(x) * ((2 * np.abs(x) + step) // (2 * step))
    row, at = np.nonzero(impact)
    value = impact[row, at]
    order = np.lexsort((row, value, at, -np.abs(value)))
    row, at, value = row[order], at[order], value[order]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (value[1:] != value[:-1])]) if len(row) else np.zeros(0, int)
    ends = np.r_[first[1:], len(row)].astype(int) if len(row) else first
    sizes = np.abs(value[first])
    # A stop lies between impacts of different size, after about each STOPS-th of the postings, and at the end.
    falls = np.flatnonzero(np.r_[sizes[1:] != sizes[:-1], True]) if len(sizes) else np.zeros(0, int)
    wanted = np.searchsorted(ends[falls], np.linspace(0, len(row), STOPS + 1)[1:]) if len(falls) else falls
    stops = falls[np.unique(np.minimum(wanted, len(falls) - 1))] if len(falls) else falls
    missing = [np.sqrt(((x - np.where(np.abs(impact) >= sizes[s], impact * step, 0)).astype(float) ** 2).sum(axis=1)) for s in stops]
    return {
        "step": step, "docs": row.astype(np.uint16).tobytes(), "dims": at[first].tolist(), "impacts": value[first].tolist(), "ends": ends.tolist(),
        "stops": (stops + 1).tolist(), "missing": np.array(missing, np.float64).tobytes(),
    }


def _narrow(x: np.ndarray) -> np.ndarray:
    """The integers in two or eight bytes."""
    return x.astype(np.int16) if np.abs(x).max(initial=0) < 2**15 else x


def build(rows: DataFrame) -> DataFrame:
    """The index of rows(id, x), one row a block; no shuffle. Write it before it is searched: block numbers are those of the run."""
    share_code(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}
        part, made = TaskContext.get().partitionId() << 32, 0

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, parts = waiting.pop(dim)
            x = np.vstack(parts)
            row = {"dim": dim, "block": part + made, "ids": ids, "vectors": _narrow(x).tobytes()} | _segments(x)
            made += 1
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            ids, lists = b.column(0).to_pylist(), b.column(1)
            sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                while len(at):
                    old, parts = waiting.setdefault(dim, ([], []))
                    now, at = at[: BLOCK - len(old)], at[BLOCK - len(old) :]
                    old += [ids[k] for k in now]
                    parts.append(flat[starts[now][:, None] + np.arange(dim)])
                    if len(old) == BLOCK:
                        yield block(dim)
        for dim in list(waiting):
            yield block(dim)

    ints = pa.list_(pa.int32())
    schema = pa.schema([
        ("dim", pa.int32()), ("block", pa.int64()), ("step", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("docs", pa.binary()), ("dims", ints),
        ("impacts", ints), ("ends", ints), ("stops", ints), ("missing", pa.binary()),
    ])
    return rows.mapInArrow(run, INDEX)


def _vectors(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if len(raw) == 2 * rows * dim else np.int64).reshape(rows, dim)


def own_queries(index: DataFrame, every: int) -> DataFrame:
    """query_id, dim, x (eight-byte integers) and place (block, row) of the indexed rows whose id is divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = _vectors(r["vectors"], len(r["ids"]), r["dim"])
                at = [k for k, v in enumerate(r["ids"]) if v is not None and v % every == 0]
                rows = {"query_id": [r["ids"][k] for k in at], "dim": [r["dim"]] * len(at), "x": [x[k].astype(np.int64).tobytes() for k in at], "block": [r["block"]] * len(at), "row": at}
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("query_id", pa.int64()), ("dim", pa.int32()), ("x", pa.binary()), ("block", pa.int64()), ("row", pa.int32())]))

    return index.select("dim", "block", "ids", "vectors").mapInArrow(run, "query_id long, dim int, x binary, block long, row int")


class _Best:
    """The best k rows of each query of a pass so far: by score, then by id, null ids last."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.query, self.score, self.id, self.null = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        query, score, ids, null = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[rank < self.k]
        self.query, self.score, self.id, self.null = query[rank < self.k], score[keep], ids[keep], null[keep]
        last = rank == self.k - 1
        self.least[query[last]] = score[order[last]]


def _exact(x: np.ndarray, queries: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of paired rows and queries, in integers."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * x.shape[1]
    if most >= 2.0**63:
        raise OverflowError("an inner product may not fit a long")
    kind = np.float64 if most < 2.0**53 else np.int64
    out = np.empty(len(row), np.int64)
    for s in range(0, len(row), PAIRS):
        out[s : s + PAIRS] = np.einsum("ij,ij->i", x[row[s : s + PAIRS]].astype(kind), queries[query[s : s + PAIRS]].astype(kind))
    return out


def _scan(block: dict, q: np.ndarray, place: np.ndarray, best: _Best) -> None:
    """Read one block's segments for one pass of queries, and add what may be among the best."""
    dim, rows = block["dim"], len(block["ids"])
    x, docs = block["x"], block["docs"]
    columns = (q.T * float(block["step"])).astype(np.float32)
    length = np.linalg.norm(q.astype(float), axis=1)
    # Accumulators are single precision: what rounding can add up to belongs to the bound.
    slip = length * block["longest"] * dim * 2.0**-22
    total = np.zeros((rows, len(q)), np.float32)
    own = np.flatnonzero(place[:, 0] == block["block"])
    begin = at = 0
    possible = None
    for stop, missing in zip(block["stops"], block["missing"]):
        for k in range(begin, stop):
            total[docs[at : block["ends"][k]]] += columns[block["dims"][k]] * block["impacts"][k]
            at = block["ends"][k]
        begin = stop
        if np.isfinite(best.least).all():
            possible = total >= best.least - slip - missing[:, None] * length
            if possible.sum() <= FEW * possible.size:
                break
    total[place[own, 1], own] = -np.inf
    if possible is None or not np.isfinite(best.least).all():
        # No k rows are known yet: those with the largest accumulators are scored first.
        k = min(best.k, rows)
        top = np.argpartition(-total, k - 1, axis=0)[:k]
        row, query = top.ravel(), np.tile(np.arange(len(q)), k)
        some = total[row, query] > -np.inf
        row, query = row[some], query[some]
        known = _Best(len(q), best.k)
        known.add(query, _exact(x, q, row, query), block["id"][row], block["null"][row])
        least = np.maximum(best.least, known.least)
        missing = block["missing"][-1] if len(block["missing"]) else block["length"]
        possible = total >= least - slip - missing[:, None] * length
    possible[place[own, 1], own] = False
    row, query = np.nonzero(possible)
    best.add(query, _exact(x, q, row, query), block["id"][row], block["null"][row])


def _opened(r: dict) -> dict:
    x = _vectors(r["vectors"], len(r["ids"]), r["dim"])
    length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    return r | {
        "x": x, "docs": np.frombuffer(r["docs"], np.uint16), "missing": np.frombuffer(r["missing"]).reshape(len(r["stops"]), len(x)) * (1 + 1e-9), "length": length,
        "longest": float(length.max()) * 2 + float(r["step"]) * np.sqrt(x.shape[1]), "null": np.array([v is None for v in r["ids"]]), "id": np.array([v or 0 for v in r["ids"]], np.int64),
    }


def search(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row of queries (as :func:`own_queries` gives them).

    index and queries are written tables. A round is a share of the queries by hash, one pass over the index.
    """
    spark = index.sparkSession
    rounds = max(1, -(-queries.count() // QUERIES))
    share, found = F.pmod(F.xxhash64("block", "row"), F.lit(rounds)), []
    for n in range(rounds):
        some = queries.filter(share == n).limit(2 * QUERIES + 1).collect()
        if len(some) > 2 * QUERIES:
            raise RuntimeError("a round has more queries than its bound")
        by: dict[int, tuple] = {}
        for dim in {r.dim for r in some}:
            mine = [r for r in some if r.dim == dim]
            by[dim] = (np.frombuffer(b"".join(r.x for r in mine), np.int64).reshape(-1, dim), np.array([(r.block, r.row) for r in mine], np.int64), np.array([r.query_id for r in mine], np.int64))
        sent = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, best = sent.value, {}
            for b in batches:
                for r in b.to_pylist():
                    if r["dim"] not in asked:
                        continue
                    block, (q, place, _) = _opened(r), asked[r["dim"]]
                    for s in range(0, len(q), BATCH):
                        _scan(block, q[s : s + BATCH], place[s : s + BATCH], best.setdefault((r["dim"], s), _Best(len(q[s : s + BATCH]), k)))
            for (dim, s), x in best.items():
                _, place, ids = asked[dim]
                at = x.query + s
                yield pa.RecordBatch.from_arrays([pa.array(place[at, 0]), pa.array(place[at, 1], pa.int32()), pa.array(ids[at]), pa.array(x.id, mask=x.null), pa.array(x.score)], ["block", "row", "query_id", "vec_id", "score"])

        found.append(written(index.mapInArrow(run, "block long, row int, query_id long, vec_id long, score long"), "best"))
        sent.destroy()
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("block", "row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best rows for each row of the table whose id is divisible by ``every``."""
    index = written(build(integers(vectors, key, vector)), "impacts", codec="lz4")
    queries = written(own_queries(index, every), "queries")
    out = search(index, queries, k)
    drop_written(index, queries)
    return out
