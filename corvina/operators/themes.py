"""Themes of an entity graph: communities by modularity, found in written rounds, and what each is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from corvina.scratch import drop_written, written

ROUNDS, LEVELS = 12, 4
#: Products of two weights fit a long up to this total; beyond it they are decimals, which are far slower.
LONG = 2**31


def _both_ways(edges: DataFrame) -> DataFrame:
    """a, b, w in both directions; a loop stands once with twice its weight."""
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").cast("long").alias("w")).filter("a is not null and b is not null")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def _moved(links: DataFrame, degree: DataFrame, label: DataFrame, total: int, down: bool) -> tuple[DataFrame, int]:
    """Labels after one round and how many nodes moved.

    A node takes the community beside it with the largest gain (ties: the least label), if that beats its own; in even rounds
    only to lesser labels, in odd ones only to greater, so that two nodes don't swap for ever. Gains are whole numbers.
    """
    size = label.join(degree, "node").groupBy("community").agg(F.sum("k").alias("t"))
    # What a round needs of a node, its community's size included, is joined on rows of nodes, not of links.
    state = written(label.join(degree, "node").join(size, "community").select("node", F.col("community").alias("mine"), "k", F.col("t").alias("size")), "states")
    far = state.select(F.col("node").alias("b"), F.col("mine").alias("community"), F.col("size").alias("t"))
    beside = links.filter("a <> b").join(far, "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("w"), F.max("t").alias("t"))
    offers = state.join(beside, "node", "left")
    own = F.col("community") == F.col("mine")
    way = F.col("community") < F.col("mine") if down else F.col("community") > F.col("mine")
    whole = "long" if total < LONG else "decimal(38,0)"
    loss = lambda w, rest: F.col("k").cast(whole) * rest - F.lit(total).cast(whole) * w
    offer = F.struct(loss(F.col("w"), F.col("t") - F.when(own, F.col("k")).otherwise(0)).alias("loss"), (~own).alias("other"), "community")
    # Equal gains: the own community stays, then the least label. A node without links into its own community may stay there, too.
    stay = F.struct(loss(F.lit(0).cast("long"), F.col("size") - F.col("k")).alias("loss"), F.lit(False).alias("other"), F.col("mine").alias("community"))
    best = offers.groupBy("node", "mine", "k", "size").agg(F.min(F.when(own | way, offer)).alias("m"), F.coalesce(F.max(own), F.lit(False)).alias("linked"))
    best = best.select("node", F.when(F.col("linked"), F.col("m")).otherwise(F.least(F.col("m"), stay)).alias("m"))
    seen = Observation()
    step = best.select("node", F.col("m.community").alias("community"), F.col("m.other").alias("moved"))
    new = written(step.observe(seen, F.coalesce(F.sum(F.col("moved").cast("long")), F.lit(0)).alias("n")), "communities")
    drop_written(state)
    return new.select("node", "community"), seen.get["n"]


def _numbered(links: DataFrame) -> DataFrame:
    """id, node: numbers in the order of the nodes, so that the least number is that of the least node."""
    return written(links.select(F.col("a").alias("node")).distinct().orderBy("node").select(F.monotonically_increasing_id().alias("id"), "node"), "numbers")


def communities(edges: DataFrame, rounds: int = ROUNDS, levels: int = LEVELS) -> DataFrame:
    """edges(src, dst, weight) to node, community (named by one of its nodes), by greedy gains of modularity.

    Rounds run on numbers of the nodes, which are shuffled, sorted and compared faster than names.

    Rounds of a level end when neither direction moves a node, or after ``rounds``; then communities become the nodes of
    the next level. The same edges give the same communities in any order and partitioning. Edges of a hub are summed per
    task before they are shuffled; each round is written and the one before it deleted.
    """
    named = written(_both_ways(edges), "named")
    numbers = _numbered(named)
    number = lambda k: numbers.select(F.col("node").alias(k), F.col("id").alias(f"id_{k}"))
    links = written(named.join(number("a"), "a").join(number("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "w"), "links")
    drop_written(named)
    total = int(links.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0])
    out = written(links.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct(), "communities")
    for _ in range(levels):
        degree = written(links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")), "degrees")
        label, idle, moves = written(degree.select("node", F.col("node").alias("community")), "communities"), 0, 0
        for n in range(rounds):
            new, now = _moved(links, degree, label, total, n % 2 == 0)
            drop_written(label)
            label, moves, idle = new, moves + now, 0 if now else idle + 1
            if idle == 2:
                break
        drop_written(degree)
        if not moves:
            drop_written(label)
            break
        name = lambda k: label.select(F.col("node").alias(k), F.col("community").alias(f"c_{k}"))
        merged = links.join(name("a"), "a").join(name("b"), "b").groupBy(F.col("c_a").alias("a"), F.col("c_b").alias("b")).agg(F.sum("w").alias("w"))
        further = written(merged, "links")
        higher = written(out.join(label.select(F.col("node").alias("community"), F.col("community").alias("top")), "community").select("node", F.col("top").alias("community")), "communities")
        drop_written(links, out, label)
        links, out = further, higher
    drop_written(links)
    name = lambda k: numbers.select(F.col("id").alias(k), F.col("node").alias(f"{k}_name"))
    told = out.join(name("node"), "node").join(name("community"), "community").select(F.col("node_name").alias("node"), F.col("community_name").alias("community"))
    label = written(told, "themes")
    drop_written(out, numbers)
    return label


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """One row: modularity, the share of weight inside communities beyond what degrees alone would give."""
    links = _both_ways(edges)
    name = lambda k: label.select(F.col("node").alias(k), F.col("community").alias(f"c_{k}"))
    each = links.join(name("a"), "a").join(name("b"), "b").groupBy("c_a").agg(F.sum("w").alias("t"), F.sum(F.when(F.col("c_a") == F.col("c_b"), F.col("w")).otherwise(0)).alias("inside"))
    m = links.agg(F.sum("w").alias("m"))
    return each.join(F.broadcast(m)).agg(F.sum(F.col("inside") / F.col("m") - (F.col("t") / F.col("m")) * (F.col("t") / F.col("m"))).alias("modularity"))


def summaries(label: DataFrame, entities: DataFrame, edges: DataFrame, leads: int = 3) -> DataFrame:
    """theme, n_entities, by_type (counts), leads (names of the entities with the most edges), weight (of the edges inside).

    entities(entity_id, type, name). Entities that the graph doesn't know belong to no theme.
    """
    known = entities.join(label, entities["entity_id"] == label["node"]).select("entity_id", "type", "name", F.col("community").alias("theme"))
    kinds = known.groupBy("theme", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("theme").agg(F.sum("n").alias("n_entities"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    degree = _both_ways(edges).groupBy(F.col("a").alias("entity_id")).agg(F.sum("w").alias("k"))
    order = Window.partitionBy("theme").orderBy(F.desc("k"), "entity_id")
    first = known.join(degree, "entity_id").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= leads)
    named = first.groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("leads"))
    name = lambda k: label.select(F.col("node").alias(k), F.col("community").alias(f"c_{k}"))
    inside = edges.join(name("src"), "src").join(name("dst"), "dst").filter("c_src = c_dst").groupBy(F.col("c_src").alias("theme")).agg(F.sum("weight").alias("weight"))
    return kinds.join(named, "theme", "left").join(inside, "theme", "left").select("theme", "n_entities", "by_type", "leads", F.coalesce("weight", F.lit(0)).alias("weight"))
