"""Rounds of communities run on numbers."""

import random

from corvina.operators import themes


def test_rounds_compare_whole_numbers(spark, monkeypatch):
    kinds, plans, real = {}, [], themes.written

    def seen(df, name, **how):
        kinds.setdefault(name, dict(df.dtypes))
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name, **how)

    rng = random.Random(5)
    edges = [(f"p{rng.randrange(3, 14)}", f"s{rng.randrange(3, 14)}", rng.randint(1, 3)) for _ in range(25)]
    df = spark.createDataFrame(edges, "src string, dst string, weight long")
    monkeypatch.setattr(themes, "written", seen)
    got = {r.node: r.community for r in themes.communities(df, 2, 1).collect()}
    assert kinds["states"]["node"] == kinds["states"]["mine"] == "bigint" and "decimal" not in "".join(plans)
    assert set(got) == {x for a, b, _ in edges for x in (a, b)} and set(got.values()) <= set(got)
    # Totals whose products don't fit a long are decimals; the result is the same.
    monkeypatch.setattr(themes, "LONG", 0)
    assert {r.node: r.community for r in themes.communities(df, 2, 1).collect()} == got and "decimal" in "".join(plans)
