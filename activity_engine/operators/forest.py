"""Minimum spanning forests, and connected components by following pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.session import written


def follow(pointers: DataFrame) -> DataFrame:
    """(at, to) with every ``to`` replaced by the end of its chain: each round a pointer takes over the pointer it points at,
    so the rounds grow with the logarithm of the longest chain. Ends point at themselves or are not in the table."""
    held = written(pointers.select("at", "to"))
    while True:
        ahead = held.select(F.col("at").alias("__at"), F.col("to").alias("__to"))
        moved = written(held.join(ahead, F.col("to") == F.col("__at"), "left").select(
            "at", F.coalesce("__to", "to").alias("to"), (F.coalesce("__to", "to") != F.col("to")).alias("__moved")))
        if not moved.where("__moved").limit(1).count():
            return moved.select("at", "to")
        held = moved.select("at", "to")


def _picks(live: DataFrame) -> DataFrame:
    """The least edge of every component, with the component at its other end."""
    there = live.select(F.col("ca").alias("at"), F.struct("w", "a", "b", F.col("cb").alias("to")).alias("e"))
    back = live.select(F.col("cb").alias("at"), F.struct("w", "a", "b", F.col("ca").alias("to")).alias("e"))
    return there.unionByName(back).groupBy("at").agg(F.min("e").alias("e")).select("at", "e.*")


def spanning_forest(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest's edges (a, b, w), and (node, tree) with each node's tree.

    Borůvka: in each round every component picks its least edge by (w, a, b), and components that picks connect become one.
    A pair of components keeps only its least edge, so the graph shrinks by half or more each round. ``edges`` has one row
    for each pair a < b.
    """
    live = written(edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    labels = written(nodes.select("node", F.col("node").alias("tree")))
    chosen = None
    while True:
        picks = written(_picks(live))
        if not picks.limit(1).count():
            break
        part = picks.select("a", "b", "w").distinct()
        chosen = part if chosen is None else chosen.unionByName(part)
        # Two components that picked the same edge point at each other: the smaller one is the root.
        other = picks.select(F.col("at").alias("to"), F.col("to").alias("__back"))
        root = (F.col("__back") == F.col("at")) & (F.col("at") < F.col("to"))
        pointers = picks.join(other, "to").select("at", F.when(root, F.col("at")).otherwise(F.col("to")).alias("to"))
        ends = follow(pointers)
        for column in ("ca", "cb"):
            at = ends.select(F.col("at").alias(column), "to")
            live = live.join(at, column, "left").withColumn(column, F.coalesce("to", column)).drop("to")
        swapped = F.col("ca") > F.col("cb")
        pair = [F.when(swapped, F.col("cb")).otherwise(F.col("ca")).alias("ca"), F.when(swapped, F.col("ca")).otherwise(F.col("cb")).alias("cb")]
        live = live.where("ca <> cb").select("a", "b", "w", *pair).groupBy("ca", "cb").agg(F.min(F.struct("w", "a", "b")).alias("e"))
        live = written(live.select("e.a", "e.b", "e.w", "ca", "cb"))
        labels = written(labels.join(ends, labels["tree"] == ends["at"], "left").select("node", F.coalesce("to", "tree").alias("tree")))
    if chosen is None:
        chosen = edges.select("a", "b", "w").where("false")
    return written(chosen), labels
