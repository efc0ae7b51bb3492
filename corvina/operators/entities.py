"""Entities, aliases, relationships and lineage as relational plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from corvina.functions.text import canonical_identity
from corvina.scratch import drop_written, written


def upsert_latest(records: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Last write wins per key; the order must be total."""
    latest = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return records.groupBy(*keys).agg(latest, F.count(F.lit(1)).alias("writes")).select(*keys, *[f"v.{c}" for c in values], "writes")


def search(entities: DataFrame, terms: list[str], k: int, text_cols: list[str]) -> DataFrame:
    """Entities whose identity, name or fields contain any term, newest first."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in text_cols]))
    hit = F.lit(False)
    for t in terms[:8]:
        hit = hit | text.contains(t)
    return entities.filter(hit).orderBy(F.desc("created_at"), "entity_id").limit(max(1, min(k, 100)))


def mentions(mention_rows: DataFrame, files: DataFrame) -> DataFrame:
    """Mentions with their file's name; an inner equi-join."""
    return mention_rows.join(files, "file_id")


def spans(entities: DataFrame, most_fields: int = 50, most_chars: int = 500) -> DataFrame:
    """One provenance span per field, shortened; repeated spans collapse."""
    entry = F.posexplode(F.slice(F.map_entries("fields"), 1, most_fields)).alias("field_index", "e")
    return entities.select("entity_id", "file_id", entry).select(
        "entity_id", "file_id", F.col("e.key").alias("field"), F.substring(F.concat_ws(": ", "e.key", "e.value"), 1, most_chars).alias("excerpt")
    ).dropDuplicates()


def lineage(entities: DataFrame, start: DataFrame) -> DataFrame:
    """entities(entity_id, parent_id), start(entity_id): the ancestors of every start, with their depth, at any depth.

    Pointer doubling: with the ancestors up to depth L and the L-th ancestor of every entity, one join gives those up to
    2 L, so a chain takes as many rounds as its length has binary digits. An ancestor counts once, at its least depth, and
    no start is its own: on a cycle the climb ends when a round finds nobody new. Only entities that exist are
    ancestors. Each round is written and the one before it deleted.
    """
    once = entities.select("entity_id", "parent_id").filter("parent_id is not null").distinct()
    have = entities.select(F.col("entity_id").alias("parent_id")).distinct()
    jump = written(once.join(have, "parent_id").select(F.col("entity_id").alias("at"), F.col("parent_id").alias("above")).filter("at <> above"), "lineage-jumps")
    begin = start.select(F.col("entity_id").alias("start_id")).distinct().join(jump, F.col("start_id") == F.col("at"))
    found, rows = _counted(begin.select("start_id", F.col("above").alias("entity_id"), F.lit(1).alias("depth")), "lineage")
    length = 1
    while rows:
        on = found.join(jump, found["entity_id"] == jump["at"]).select("start_id", F.col("above").alias("entity_id"), (F.col("depth") + length).alias("depth"))
        more = found.unionByName(on).filter("start_id <> entity_id").groupBy("start_id", "entity_id").agg(F.min("depth").alias("depth"))
        new, now = _counted(more, "lineage")
        drop_written(found)
        found = new
        if now == rows:
            break
        above = jump.select(F.col("at").alias("above"), F.col("above").alias("top"))
        further, left = _counted(jump.join(above, "above").select("at", F.col("top").alias("above")).distinct(), "lineage-jumps")
        drop_written(jump)
        jump, rows, length = further, now, 2 * length
        if not left:
            break
    drop_written(jump)
    return found


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The written rows and their number, from one job."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def children(entities: DataFrame) -> DataFrame:
    return entities.filter("parent_id is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"), F.min("entity_id").alias("first_child"))


def aliases(entities: DataFrame) -> DataFrame:
    """type, alias, entity_id: exact and canonical identities; of equal aliases the last entity wins."""
    both = F.array_distinct(F.array("identity_key", canonical_identity(F.col("identity_key"))))
    exploded = entities.select("type", "entity_id", F.explode(both).alias("alias"))
    return exploded.groupBy("type", "alias").agg(F.max("entity_id").alias("entity_id"))


def relationship_candidates(refs: DataFrame, entity_aliases: DataFrame) -> DataFrame:
    """refs(source_id, rel_type, target_type, value) resolved to edges: no self loops, one edge per (type, source, target)."""
    resolved = refs.join(entity_aliases, (refs["target_type"] == entity_aliases["type"]) & (refs["value"] == entity_aliases["alias"]))
    edges = resolved.select("rel_type", F.col("source_id"), F.col("entity_id").alias("target_id")).filter("source_id <> target_id")
    return edges.distinct()


def missing_edges(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates that are not edges yet; running it again after inserting them finds none."""
    return candidates.join(edges, ["rel_type", "source_id", "target_id"], "left_anti")


def named_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with display names (else identity keys) of both ends; ends may be unknown."""
    name = F.coalesce("display_name", "identity_key")
    src = entities.select(F.col("entity_id").alias("source_id"), name.alias("source_name"))
    dst = entities.select(F.col("entity_id").alias("target_id"), name.alias("target_name"))
    return edges.join(src, "source_id", "left").join(dst, "target_id", "left")


def expand(edges: DataFrame, seeds: DataFrame, per_seed: int = 8, most: int = 8) -> DataFrame:
    """Edges at either end of the seeds(entity_id, pos): two equi-joins instead of one disjunction.

    Per seed the newest edges, one row per edge (its first seed), then the overall limit.
    """
    narrow = edges.select("edge_id", "source_id", "target_id", "rel_type", "created_at")
    touch = narrow.join(seeds, F.col("source_id") == F.col("entity_id")).unionByName(narrow.join(seeds, F.col("target_id") == F.col("entity_id")))
    newest = Window.partitionBy("entity_id").orderBy(F.desc("created_at"), "edge_id")
    kept = touch.dropDuplicates(["entity_id", "edge_id"]).withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= per_seed)
    once = kept.groupBy("edge_id", "source_id", "target_id", "rel_type").agg(F.min(F.struct("pos", "r")).alias("at"))
    return (
        once.orderBy("at.pos", "at.r", "edge_id").limit(most)
        .select("edge_id", "source_id", "target_id", "rel_type", F.col("at.pos").alias("pos"), (0.9 / (F.col("at.pos") + 1)).alias("score"),
                F.concat_ws(" ", F.col("source_id").cast("string"), "rel_type", F.col("target_id").cast("string")).alias("text"))
    )


def broken_references(rows: DataFrame, fk: str, parents: DataFrame, pk: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return rows.filter(F.col(fk).isNotNull()).join(parents.select(F.col(pk).alias(fk)), fk, "left_anti")
