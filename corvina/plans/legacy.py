"""Import of an earlier system's tables: defaults, parents that are missing, first rows of a key, order by parents, checks, checksums."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corvina.functions.text import stable_json
from corvina.scratch import drop_written, written


@dataclass(frozen=True)
class Spec:
    """What a table must look like: its columns with defaults (None for none), key, required columns, and references.

    references: (columns, table, columns of that table); an empty reference is allowed unless the column is required.
    """

    columns: dict[str, Column | None]
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    references: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    parent: str | None = None
    flags: tuple[str, ...] = field(default=())


def flag(value: Column) -> Column:
    """Truth values in whatever form they were exported, as 0 or 1."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("true", "1", "yes", "y", "t"), 1).when(text.isin("false", "0", "no", "n", "f", ""), 0)


def normalized(rows: DataFrame, spec: Spec) -> DataFrame:
    """The table's columns in order, missing ones and nulls filled from the defaults, flags as 0 or 1."""
    have = {c.lower(): c for c in rows.columns}
    out = []
    for name, default in spec.columns.items():
        value = F.col(have[name.lower()]) if name.lower() in have else F.lit(None).cast("string")
        value = flag(value) if name in spec.flags else value
        out.append((value if default is None else F.coalesce(value, default)).alias(name))
    order = [F.col("_place")] if "_place" in rows.columns else []
    return rows.select(*out, *order)


def first_of_key(rows: DataFrame, key: tuple[str, ...], place: str = "_place") -> DataFrame:
    """The row of each key that came first; null and empty parts of a key are equal."""
    names = {k: f"_{k}" for k in key}
    rest = F.min_by(F.struct(*rows.columns), place).alias("row")
    return rows.select("*", *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(n) for k, n in names.items()]).groupBy(*names.values()).agg(rest).select("row.*")


def with_scopes(projects: DataFrame, domains: DataFrame, children: list[DataFrame], default: str = "default") -> tuple[DataFrame, DataFrame]:
    """projects(name) and domains(project, name), with those that children(project, domain) name and nobody declared."""
    scopes = None
    for c in children:
        one = c.select(F.coalesce(F.nullif(F.col("project"), F.lit("")), F.lit(default)).alias("project"), F.col("domain").alias("name")).filter("name is not null and name <> ''").distinct()
        scopes = one if scopes is None else scopes.unionByName(one)
    scopes = scopes.distinct()
    new = scopes.join(domains, ["project", "name"], "left_anti")
    spark = projects.sparkSession
    wanted = scopes.select(F.col("project").alias("name")).distinct().unionByName(spark.createDataFrame([(default,)], "name string")).distinct()
    return projects.select("name").unionByName(wanted.join(projects, "name", "left_anti")), domains.select("project", "name").unionByName(new)


def complete(rows: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(rows with everything that is required, rows without, each with the list of what is missing)."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in spec.required] or [F.lit(None).cast("string")]), lambda c: c.isNotNull())
    marked = rows.withColumn("missing", missing)
    return marked.filter(F.size("missing") == 0).drop("missing"), marked.filter(F.size("missing") > 0)


def broken(tables: dict[str, DataFrame], specs: dict[str, Spec]) -> DataFrame:
    """table, reference, key of every row whose reference leads nowhere: one anti-join a reference."""
    out = None
    for table, spec in specs.items():
        for columns, target, theirs in spec.references:
            given = tables[table].filter(" and ".join(f"`{c}` is not null and cast(`{c}` as string) <> ''" for c in columns))
            there = tables[target].select(*[F.col(b).alias(f"_to{n}") for n, b in enumerate(theirs)]).distinct()
            on = [given[a] == there[f"_to{n}"] for n, a in enumerate(columns)]
            key = F.concat_ws("/", *[given[k].cast("string") for k in spec.key])
            one = given.join(there, on, "left_anti").select(F.lit(table).alias("table"), F.lit("/".join(columns)).alias("reference"), key.alias("key"))
            out = one if out is None else out.unionByName(one)
    return out


def levels(rows: DataFrame, key: str = "id", parent: str = "parent_id", place: str = "_place") -> DataFrame:
    """key, parent, level (roots are 0): an order in which parents come first. Each key stands once.

    A parent that isn't there makes a root (the reference stays). Where parents form a cycle, the reference is cleared at
    which the cycle is entered from its earliest row or follower, as a walk through the rows in their order would do.
    Pointers are doubled in written rounds, their number is the logarithm of the longest chain. Only rows that others name as
    parents take part: the rest stand one below their parent, and count for a cycle as followers of their parent.
    """
    known = rows.select(F.col(key).alias("id"), F.col(parent).alias("given"), F.col(place).alias("place")).filter("id is not null")
    ids = known.select(F.col("id").alias("given"), F.lit(True).alias("there"))
    named = known.filter("given is not null").select(F.col("given").alias("id"), F.lit(True).alias("inner")).distinct()
    step = known.join(ids, "given", "left").join(named, "id", "left").select("id", "given", F.when(F.col("there"), F.col("given")).alias("up"), "place", F.coalesce("inner", F.lit(False)).alias("inner"))
    step = written(step, "steps")
    inner, ends = step.filter("inner"), step.filter("not inner")
    first = ends.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.min(F.struct("place", F.col("id").alias("of"))).alias("follower"))
    core = inner.join(first, "id", "left").select("id", "up", F.least(F.struct("place", F.col("id").alias("of")), "follower").alias("place"))
    core = written(core, "cores")
    broken_at = _cycle_entries(core)
    cut = core.join(broken_at.select(F.col("entry").alias("id"), F.lit(True).alias("cut")), "id", "left")
    forest = written(cut.select("id", F.when(F.col("cut").isNull(), F.col("up")).alias("up"), F.coalesce("cut", F.lit(False)).alias("cut")), "forest")
    depth, more = written(forest.select("id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("level")), "depths"), True
    while more:
        seen = Observation()
        above = depth.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("level").alias("plus"))
        on = depth.join(above, "up", "left").select("id", F.col("top").alias("up"), (F.col("level") + F.coalesce("plus", F.lit(0))).alias("level"))
        new = written(on.observe(seen, F.count("up").alias("n")), "depths")
        more = seen.get["n"] > 0
        drop_written(depth)
        depth = new
    own = inner.join(depth.select("id", "level"), "id").join(forest.select("id", "cut"), "id").select("id", F.when(~F.col("cut"), F.col("given")).alias("given"), "level")
    below = ends.join(depth.select(F.col("id").alias("up"), (F.col("level") + 1).alias("under")), "up", "left").select("id", "given", F.coalesce("under", F.lit(0)).alias("level"))
    done = written(own.unionByName(below).select(F.col("id").alias(key), F.col("given").alias(parent), "level"), "levels")
    drop_written(step, core, forest, depth, broken_at)
    return done


def _cycle_entries(step: DataFrame) -> DataFrame:
    """entry: the key of each cycle of step(id, up, place) at which its earliest follower enters it."""
    jump = written(step.filter("up is not null").select("id", "up"), "jumps")
    left = jump.count()
    # After as many doublings only keys whose chain has no end still have a pointer, and all of those point into cycles.
    length, nodes = 1, step.count()
    while left and length < nodes:
        seen = Observation()
        on = jump.select(F.col("id").alias("up"), F.col("up").alias("top"))
        new = written(jump.join(on, "up").select("id", F.col("top").alias("up")).observe(seen, F.count(F.lit(1)).alias("n")), "jumps")
        left, length = seen.get["n"], 2 * length
        drop_written(jump)
        jump = new
    if not left:
        drop_written(jump)
        return step.select(F.col("id").alias("entry")).limit(0)
    cyclic = written(jump.select(F.col("up").alias("id")).distinct(), "cyclic")
    # Least key of each cycle: minima over stretches of doubled length.
    ring = written(step.join(cyclic, "id").select("id", "up", F.col("id").alias("least")), "rings")
    size, length = cyclic.count(), 1
    while length < size:
        on = ring.select(F.col("id").alias("up"), F.col("up").alias("top"), F.col("least").alias("other"))
        new = written(ring.join(on, "up").select("id", F.col("top").alias("up"), F.least("least", "other").alias("least")), "rings")
        drop_written(ring)
        ring, length = new, 2 * length
    # Followers: pointers run until they stand on a cycle.
    inside = cyclic.withColumn("on", F.lit(True))
    endless = step.join(jump.select("id"), "id").join(inside, "id", "left").select("id", F.when(F.col("on"), F.col("id")).otherwise(F.col("up")).alias("at"), "place")
    walk, moving = written(endless, "walks"), True
    while moving:
        seen = Observation()
        on = walk.select(F.col("id").alias("at"), F.col("at").alias("next"))
        stepped = walk.join(on, "at").select("id", F.col("next").alias("at"), "place", (F.col("next") != F.col("at")).alias("moved"))
        new = written(stepped.observe(seen, F.coalesce(F.max("moved"), F.lit(False)).alias("moved")), "walks")
        moving = seen.get["moved"]
        drop_written(walk)
        walk = new.select("id", "at", "place")
    entry = walk.join(ring.select(F.col("id").alias("at"), "least"), "at").groupBy("least").agg(F.min_by("at", F.struct("place", "id")).alias("entry"))
    out = written(entry.select("entry"), "entries")
    drop_written(jump, cyclic, ring, walk)
    return out


def checksum(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, checksum of each: the sum of the rows' hashes, so it depends neither on their order nor on partitions.

    A row's hash is over its canonical JSON, keys in order and nulls left out; equal rows add up, so a lost copy shows.
    """
    out = None
    for name, rows in tables.items():
        entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in sorted(rows.columns)])
        text = stable_json(F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))
        number = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
        one = rows.select(number.alias("h")).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("checksum"))
        out = one if out is None else out.unionByName(one)
    return out


def load(tables: dict[str, DataFrame], specs: dict[str, Spec]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables ready to be inserted, in the order of specs, and their problems (table, problem, key).

    Rows are normalised, the first of each key stays, rows without required values go, parents get a level column.
    """
    out, problems = {}, None
    for name, spec in specs.items():
        rows = normalized(tables[name], spec)
        once = first_of_key(rows, spec.key)
        good, bad = complete(once, spec)
        key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in spec.key])
        said = bad.select(F.lit(name).alias("table"), F.concat(F.lit("missing "), F.array_join("missing", ",")).alias("problem"), key.alias("key"))
        problems = said if problems is None else problems.unionByName(said)
        if spec.parent:
            order = levels(good, spec.key[0], spec.parent)
            good = good.drop(spec.parent).join(order, spec.key[0])
        out[name] = good.drop("_place")
    lost = broken(out, specs)
    if lost is not None:
        problems = problems.unionByName(lost.select("table", F.concat(F.lit("broken "), "reference").alias("problem"), "key"))
    return out, problems
