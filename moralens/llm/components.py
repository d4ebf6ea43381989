"""Connected components by alternating large and small stars; every step is joins and aggregates.

No task ever holds a component: the least neighbour of a node is a map-side combined minimum, and a
hot node's edges are ordinary rows of a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moralens.staging import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node (larger ones, or the smaller ones and itself) on the least."""
    forth = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        around = forth.unionByName(forth.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = forth.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = around.join(least, "u")
    if large:
        moved = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Loops and repeated edges do no harm; edges with a NULL end are ignored; no edges, no rows.
    """
    known = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct()
    state = None
    known = stage(known, "edges")
    while True:
        known = stage(_star(_star(known, large=True), large=False), "edges")
        now = known.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    # all edges are now (node, least node)
    least = known.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return known.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(least)
