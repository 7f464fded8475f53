"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattline.llm import kit


EDGES_PER_TASK = 200_000


def _least(pairs: DataFrame) -> DataFrame:
    """Each ``u`` with the least of itself and its ``v``."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (``a``, ``b``); the component is its least node.

    A step joins edges only to the least neighbour of a node, so a node with very many edges costs its edges, not
    their pairs. Loops and repeated edges do no harm; no edges give no rows.
    """
    now = kit.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    tasks = now.count() // EDGES_PER_TASK + 1  # the graph shrinks from here on

    def kept(df: DataFrame, label: str) -> DataFrame:
        return kit.materialize(df.coalesce(tasks), label)

    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(kept(_least(both), "components-least"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.where("u <> v").distinct(), "components-large")
        least = kept(_least(large), "components-least")
        small = large.join(least, "u")
        now = kept(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "components")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
