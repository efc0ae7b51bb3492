import math
import random

from corvina.operators import metrics, selection


def test_nearest_ranks(spark):
    rng = random.Random(2)
    rows = [("hot", float(rng.choice([5, 5, 5, rng.lognormvariate(3, 2)]))) for _ in range(30_000)] + [(f"k{n % 40}", rng.random()) for n in range(900)] + [(None, 1.0), (None, 3.0), ("none", None), ("one", 4.0)]
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: [r[p] for p in shares] for r in selection.nearest_ranks(df, ["k"], "v", shares).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: [sorted(v)[max(1, math.ceil(p * len(v))) - 1] for p in shares.values()] for k, v in groups.items()}


def test_latency_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, ms double")
    got = {r.k: (r["count"], r.p99_ms) for r in metrics.latency(df, ["k"], "ms").collect()}
    assert got == {"a": (0, None), "b": (1, 2.0)}


def test_tail(spark):
    df = spark.createDataFrame([(s, t, f"r{t}") for s in (1, 2) for t in range(s * 3)], "s long, turn long, role string")
    got = {r.s: [(h.turn, h.role) for h in r.history] for r in metrics.tail(df, "s", ["turn", "role"], 4).collect()}
    assert got == {1: [(0, "r0"), (1, "r1"), (2, "r2")], 2: [(2, "r2"), (3, "r3"), (4, "r4"), (5, "r5")]}
