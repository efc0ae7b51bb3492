"""Connected components by alternating large-star and small-star steps over a written edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import drop_written, release, shuffled_joins, written
from corvina.session import share_code

#: Edges that a task turns into stars at once, 4 MiB of them: a table of more goes to as many more tasks.
CHUNK = 1 << 18


def components(edges: DataFrame, a: str = "a", b: str = "b", chunk: int = CHUNK) -> DataFrame:
    """(node, component) of every node but the least of its component; component is the least node.

    Tasks first turn what edges they have into stars, then once more, about chunk edges a task. Up to chunk edges that
    is all; more take rounds. Each round's edges are written to the shared folder, so lineage stays short and a lost
    executor repeats one round only. Neighbour minima are combined before the shuffle, and the joins that bring
    them back have one small row per node on one side, so a hub's edges can be split. One aggregation tells whether
    all edges are stars, so no round is spent on seeing that nothing changes.
    """

    def own(edges: DataFrame) -> DataFrame:
        return written(edges.mapInArrow(_stars_of(chunk), "node long, component long"), "edges")

    share_code(edges.sparkSession)
    with shuffled_joins(edges.sparkSession):
        old = own(edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("component")).filter("node <> component"))
        rows = old.count()
        gathered = own(old.coalesce(max(1, -(-rows // chunk))))
        drop_written(old)
        old, distinct = gathered, rows <= chunk
        while rows > chunk and not _starry(old):
            pairs = old.select(F.col("node").alias("u"), F.col("component").alias("v"))
            least = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("m"))
            large = pairs.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.least("m", "u").alias("v"))
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            new = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().select(F.col("u").alias("node"), F.col("v").alias("component")), "edges")
            drop_written(old)
            old, distinct = new, True
        if not distinct:
            new = written(old.distinct(), "edges")
            drop_written(old)
            old = new
    release(edges.sparkSession)
    return old


def _starry(edges: DataFrame) -> bool:
    """Whether every node has one component, which has none itself."""
    ends = edges.select(F.col("node").alias("u"), F.col("component").alias("low"), F.lit(False).alias("center"))
    ends = ends.unionByName(edges.select(F.col("component").alias("u"), F.lit(None).cast("long").alias("low"), F.lit(True).alias("center")))
    found = ends.groupBy("u").agg(F.min("low").alias("least"), F.max("low").alias("most"), F.max("center").alias("center"))
    return found.agg(F.max(F.col("least").isNotNull() & (F.col("center") | (F.col("least") != F.col("most"))))).first()[0] is not True


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node but the least."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:
        x, y = label[x], label[y]
        if not (open_ := x != y).any():
            lower = label != np.arange(len(nodes))
            return nodes[lower], nodes[label[lower]]
        x, y = x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # labels are their own labels here
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def _stars_of(chunk: int):
    """Edges of a task to stars of the same components, chunk of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            edges = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(edges["node"].to_numpy(), edges["component"].to_numpy())], ["node", "component"])

        size = 0
        for batch in batches:
            if size and size + batch.num_rows > chunk:
                yield flush()
                held, size = [], 0
            held.append(batch)
            size += batch.num_rows
        if held:
            yield flush()

    return run
