"""The legacy import against plain Python."""

import random

from pyspark.sql import functions as F

from corvina.plans import legacy


def plain_levels(rows):
    """A walk through the rows in their order, parents first; a reference that closes a cycle is cleared where it closes."""
    up = {i: p for i, p, _ in rows}
    done, order = set(), []
    for start, _, _ in sorted(rows, key=lambda r: r[2]):
        path, at = [], start
        while at is not None and at in up and at not in done and at not in path:
            path.append(at)
            at = up[at]
        if at in path:
            up[at] = None
        done.update(path)
        order += reversed(path)
    level = {}
    for i in up:
        chain, at = [], i
        while at is not None and at in up and at not in level:
            chain.append(at)
            at = up[at]
        base = level[at] if at in level else -1
        for n, x in enumerate(reversed(chain)):
            level[x] = base + 1 + n
    return {i: (up[i], level[i]) for i in up}


def test_levels(spark):
    rng = random.Random(6)
    n = 300
    places = rng.sample(range(10 * n), n)
    rows = [(i, rng.choice([None, rng.randrange(n), rng.randrange(n), n + 5]), places[i]) for i in range(n)]
    rows += [(1000 + k, 1000 + (k + 1) % 17, 99_000 - k) for k in range(17)] + [(2000, 1003, 1), (2001, 2000, 0), (3000, 3000, 5), (4000, 4001, 7), (4001, None, 8)]
    df = spark.createDataFrame(rows, "id long, parent_id long, _place long").repartition(4)
    got = {r.id: (r.parent_id, r.level) for r in legacy.levels(df).collect()}
    assert got == plain_levels(rows)
    assert got[1003][0] is None and got[1002][0] == 1003
    assert legacy.levels(df.limit(0)).collect() == []


def test_chain_of_levels(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), (-F.col("id")).alias("_place"))
    got = legacy.levels(df)
    assert got.filter("level <> id").count() == 0 and got.count() == 3000


def test_rows_that_nobody_names_stay_out_of_the_rounds(spark, monkeypatch):
    rows = [(i, i % 5, 100 - i) for i in range(5, 400)] + [(i, (i + 1) % 5, 1000 + i) for i in range(5)] + [(900, 901, 1), (901, None, 2)]
    sizes, real = {}, legacy.written

    def counted(df, name, **how):
        out = real(df, name, **how)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(legacy, "written", counted)
    df = spark.createDataFrame(rows, "id long, parent_id long, _place long").repartition(3)
    assert {r.id: (r.parent_id, r.level) for r in legacy.levels(df).collect()} == plain_levels(rows)
    assert max(sizes["jumps"] + sizes["depths"] + sizes["walks"]) <= 6 and sizes["steps"] == [len(rows)]


def test_load(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "files": t([("f1", "p", "x", "true", 0), ("f1", "p", "y", "no", 1), ("", "p", "x", None, 2), ("f2", None, "x", "maybe", 3)], "id string, project string, domain string, ready string, _place long"),
        "chunks": t([("c1", "c2", "f1", 0), ("c2", None, "f9", 1), ("c3", "c1", "", 2), ("c4", "c4", "f2", 3)], "ID string, parent_chunk string, file_id string, _place long"),
    }
    specs = {
        "files": legacy.Spec({"id": None, "project": F.lit("default"), "domain": None, "ready": None, "bytes": F.lit(0)}, ("id",), ("id", "domain"), flags=("ready",)),
        "chunks": legacy.Spec({"id": None, "parent_chunk": None, "file_id": None}, ("id",), ("id",), ((("file_id",), "files", ("id",)),), "parent_chunk"),
    }
    out, problems = legacy.load(tables, specs)
    assert sorted((r.id, r.project, r.domain, r.ready) for r in out["files"].collect()) == [("f1", "p", "x", 1), ("f2", "default", "x", None)]
    assert {(r.id, r.parent_chunk, r.level) for r in out["chunks"].collect()} == {("c1", "c2", 1), ("c2", None, 0), ("c3", "c1", 2), ("c4", None, 0)}
    assert {tuple(r) for r in problems.collect()} == {("files", "missing id", ""), ("chunks", "broken file_id", "c2")}


def test_scopes_that_nobody_declared(spark):
    projects, domains = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("a", "x")], "project string, name string")
    children = [spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "z"), ("c", None)], "project string, domain string")]
    p, d = legacy.with_scopes(projects, domains, children)
    assert {r.name for r in p.collect()} == {"a", "b", "default"}
    assert {tuple(r) for r in d.collect()} == {("a", "x"), ("a", "y"), ("b", "x"), ("default", "z")}


def test_checksum_tells_changes_but_not_order(spark):
    rows = [(1, "a", None), (2, "b", 1.5), (2, "b", 1.5)]
    schema = "id long, name string, v double"
    one = spark.createDataFrame(rows, schema)
    value = lambda df: legacy.checksum({"t": df}).first()
    assert value(one) == value(one.select("v", "name", "id").orderBy(F.desc("id")).repartition(3))
    assert value(one).checksum != value(one.distinct()).checksum != value(spark.createDataFrame([(1, "a", 0.0), (2, "b", 1.5)], schema)).checksum
    assert tuple(value(one.limit(0))) == ("t", 0, "0")
