"""Whitening of embeddings by TSQR: centred rows, a QR per partition, R factors merged in a tree, an SVD of the last.

Components of a vector become integers floor(64 * c) + 1000000. The fit list holds each distinct integer vector
once; its column sums are exact, so rows are centred without cancellation. Each partition of the list is reduced to
its R factor, R factors are merged ``FAN`` at a time, and the right singular vectors of the last one whiten. No
covariance of the data is formed; the one that is reported measures the result, by a pass over the fit list.

What the driver holds is one d x d factor and the column sums, whatever the number of rows. Copies meet in the
distinct only after each task has dropped its own; no later step moves rows.

Edge cases: null and empty vectors and those with a null or non-finite component take no part; a component of 2**32
or more in size counts as non-finite, since sums of it would leave a long. Vectors of different lengths are fitted
and whitened among their own length, the error reported is the largest. Repeated rows are returned each, and count
once in the fit. Null ids stay null. Components without spread (below 1e-11 of the first one's) cannot be
whitened: they are left out, so a fit list of one vector returns no rows, nor does an empty table. A deviation that
does not fit a long is null. Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import drop_written, written
from corvina.session import share_code

SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**32
#: R factors that one task merges, and rows that are reduced at a time.
FAN, ROWS = 16, 4096
#: Components with less spread, relative to the first, are numerically zero.
FLAT = 1e-11


@dataclass(frozen=True)
class Fit:
    """What whitens vectors of one length: number and column sums of the fit list, directions, shares of the variance."""

    n: int
    sums: list[int]
    turn: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 per row, exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s - self.n * int(w) for s, w in zip(self.sums, whole)]
        off = x - whole
        most = (float(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 2.0**62:
            off = off * self.n - np.array(rest, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum((int(v) * self.n - r) ** 2 for v, r in zip(row, rest)) for row in off]
        return [v if v < 2**63 else None for v in exact]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows minus the mean: the mean's whole part goes in integers, its fraction in doubles."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s - n * int(w)) / n for s, w in zip(sums, whole)])


def integers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows that take part, with x: their components as integers."""
    value = F.col(vector)
    fits = F.forall(value, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    x = F.transform(value, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return vectors.filter(F.coalesce((F.size(value) > 0) & fits, F.lit(False))).withColumn("x", x)


def _blocks(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[np.ndarray, pa.RecordBatch, np.ndarray]]:
    """Matrices of the rows of one length: rows, batch, their places in the batch."""
    for b in batches:
        lists = b.column(column)
        sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            yield flat[starts[at][:, None] + np.arange(dim)], b, at


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for x, _, _ in _blocks(batches):
        dim = x.shape[1]
        n, s = total.get(dim, (0, [0] * dim))
        total[dim] = (n + len(x), [a + int(v) for a, v in zip(s, x.sum(axis=0))])
    for dim, (n, s) in total.items():
        rows = {"dim": [dim] * dim, "pos": list(range(dim)), "n": [n] * dim, "s": [str(v) for v in s]}
        yield pa.RecordBatch.from_pydict(rows, pa.schema([("dim", pa.int32()), ("pos", pa.int32()), ("n", pa.int64()), ("s", pa.string())]))


def _factors(sums: dict[int, tuple[int, list[int]]]):
    """The R factor of a partition's centred rows, for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}

        def reduce(dim: int) -> None:
            rows = [_centred(x, *sums[dim]) for x in waiting.pop(dim, [])]
            if rows:
                factor[dim] = np.linalg.qr(np.vstack([*([factor[dim]] if dim in factor else []), *rows]), mode="r")

        for x, _, _ in _blocks(batches):
            dim = x.shape[1]
            waiting.setdefault(dim, []).append(x)
            if sum(map(len, waiting[dim])) >= ROWS:
                reduce(dim)
        for dim in list(waiting):
            reduce(dim)
        part = TaskContext.get().partitionId()
        for dim, r in factor.items():
            yield pa.RecordBatch.from_pydict({"dim": [dim], "part": [part], "r": [r.tobytes()]}, pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("r", pa.binary())]))

    return run


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One R factor of up to ``FAN`` of them, in the order of their parts."""
    rows, dim = rows.sort_values("part"), int(rows["dim"].iloc[0])
    stacked = np.vstack([np.frombuffer(r).reshape(-1, dim) for r in rows["r"]])
    return pd.DataFrame({"dim": [dim], "part": [int(rows["part"].iloc[0]) // FAN], "r": [np.linalg.qr(stacked, mode="r").tobytes()]})


def _tree(factors: DataFrame) -> dict[int, np.ndarray]:
    """The R factor of all parts, by merges of ``FAN`` factors a task."""
    parts = factors.agg(F.max("part")).first()[0]
    parts = -1 if parts is None else parts
    while parts > 0:
        factors = factors.groupBy("dim", F.floor(F.col("part") / FAN).alias("group")).applyInPandas(lambda _, rows: _merged(rows), "dim int, part long, r binary")
        parts //= FAN
    return {row.dim: np.frombuffer(bytes(row.r)).reshape(-1, row.dim) for row in factors.collect()}


def fit(x: DataFrame, components: int = 16) -> dict[int, Fit]:
    """The whitening of each length from the written fit list x."""
    schema = "dim int, pos int, n long, s string"
    rows = x.mapInArrow(_sums, schema).groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim", "pos").collect()
    sums: dict[int, tuple[int, list[int]]] = {}
    for row in rows:
        sums.setdefault(row.dim, (row.n, []))[1].append(int(row.s))
    if not sums:
        return {}
    # One small row a partition; written, so that no lost executor makes the rows be reduced again.
    factors = written(x.mapInArrow(_factors(sums), "dim int, part long, r binary"), "factors")
    out = {}
    for dim, r in _tree(factors).items():
        n = sums[dim][0]
        _, spread, right = np.linalg.svd(r, full_matrices=False)
        keep = int((spread > FLAT * spread[0]).sum()) if len(spread) and spread[0] > 0 else 0
        keep = min(keep, components)
        right = right[:keep] * np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)])[:keep, None]
        variance = spread**2 / n
        out[dim] = Fit(n, sums[dim][1], right.T / np.sqrt(variance[:keep]), variance[:keep] / variance.sum() if keep else variance[:0])
    drop_written(factors)
    return out


def _moments(fits: dict[int, Fit]):
    """Products and sums of a partition's whitened rows, one row an entry; -1 is the place of the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for x, _, _ in _blocks(batches):
            f = fits[x.shape[1]]
            w = f.centred(x) @ f.turn
            total[x.shape[1]] = total.get(x.shape[1], 0.0) + np.vstack([w.T @ w, w.sum(axis=0)])
        for dim, m in total.items():
            i, j = np.indices(m.shape)
            i = np.where(i == m.shape[1], -1, i)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, dim), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(m.ravel())], ["dim", "i", "j", "v"])

    return run


def identity_error(x: DataFrame, fits: dict[int, Fit]) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    rows = x.mapInArrow(_moments(fits), "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect()
    at = {(r.dim, r.i, r.j): r.v for r in rows}
    error = [abs(v / fits[d].n - at[d, -1, i] * at[d, -1, j] / fits[d].n ** 2 - (i == j)) for (d, i, j), v in at.items() if i >= 0]
    return max(error, default=None)


def whiten(vectors: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector that takes part and component: key, component, n, deviation, whitened, explained, identity_error."""
    share_code(vectors.sparkSession)
    rows = integers(vectors.select(key, vector), vector).select(key, "x")
    distinct = written(rows.select("x").distinct(), "fit")
    fits = fit(distinct, components)
    error = identity_error(distinct, fits)
    drop_written(distinct)
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, b, at in _blocks(batches, 1):
            f = fits[x.shape[1]]
            k = f.turn.shape[1]
            if not k:
                continue
            w = f.centred(x) @ f.turn
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(each), f.n)),
                    pa.array(f.deviation(x), pa.int64()).take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(f.explained, len(x))), pa.array(np.full(len(each), error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
