"""Exact order statistics without sorting a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch of this accuracy misses a rank by at most the number of values over it.
ACCURACY = 10_000


def _names(keys: list[str]) -> list[str]:
    return [f"_k{n}" for n in range(len(keys))]


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column per share: the value at rank ceil(share * n) of the group's n non-null values.

    The first pass brackets each rank between two values of a mergeable sketch. The second counts the values below each
    bracket and each distinct value in it: a task sends a few rows per group, whatever the group's size. The rank is then
    found among the bracket's values, about two of every ``ACCURACY`` / 2 of the group. Null keys form groups too.
    """
    names, given = _names(keys), rows.select(*[F.col(k).alias(n) for k, n in zip(keys, _names(keys))], F.col(value).alias("_v")).filter("_v is not null")
    slack = 2 / ACCURACY
    around = [min(1.0, max(0.0, s + d)) for s in shares.values() for d in (-slack, slack)]
    sketch = given.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", around, ACCURACY).alias("_b"))
    rank = lambda s: F.greatest(F.lit(1), F.ceil(F.lit(s) * F.col("_n"))).cast("long")
    # The ends of the shares are open: nothing lies outside the bracket there.
    wanted = [
        F.struct(F.lit(k).alias("p"), F.when(F.lit(around[2 * k] > 0), F.col("_b")[2 * k]).alias("lo"), F.when(F.lit(around[2 * k + 1] < 1), F.col("_b")[2 * k + 1]).alias("hi"), rank(s).alias("r"))
        for k, s in enumerate(shares.values())
    ]
    brackets = sketch.select(*[F.col(n).alias(f"{n}_") for n in names], F.array(*wanted).alias("w"))
    on: Column = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}_"))
    each = given.join(brackets, on).select(*names, "_v", F.explode("w").alias("w"))
    each = each.filter(F.col("w.hi").isNull() | (F.col("_v") <= F.col("w.hi")))
    inside = F.when(F.col("w.lo").isNull() | (F.col("_v") >= F.col("w.lo")), F.col("_v"))
    counted = each.groupBy(*names, F.col("w.p").alias("p"), F.col("w.r").alias("r"), inside.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*names, "p").orderBy(F.asc_nulls_first("x")))
    found = counted.withColumn("upto", upto).filter("x is not null and upto >= r").groupBy(*names, "p").agg(F.min("x").alias("x"))
    out = found.groupBy(*names).agg(*[F.max(F.when(F.col("p") == k, F.col("x"))).alias(name) for k, name in enumerate(shares)])
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *shares)
