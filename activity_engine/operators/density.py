"""Density clusters on a grid, with noise, and the connected components they need.

Points are counted per grid cell first. Cells holding enough points are dense; dense cells that touch form a cluster;
points of a sparse cell next to a dense one join its cluster; the rest is noise (-1). It is a flat cut by cell density,
not a hierarchy of densities. Only cells are compared with each other, so any number of copies in one place costs one
cell.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_engine.operators.ordered import dense_position
from activity_engine.session import durable


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable. Labels are lowered to the neighbours' and then followed one
    more step each round, so the rounds grow with the logarithm of a chain's length rather than the length."""
    both = durable(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = durable(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = (
            both.join(labels, both["src"] == labels["node"]).groupBy("dst").agg(F.min("component").alias("_near"))
        )
        lowered = labels.join(near, labels["node"] == near["dst"], "left").select(
            "node", F.least("component", F.coalesce("_near", "component")).alias("component"),
            F.col("component").alias("_old"),
        )
        pointed = lowered.select(F.col("node").alias("_at"), F.col("component").alias("_next"))
        jumped = durable(
            lowered.join(pointed, lowered["component"] == pointed["_at"]).select(
                "node", F.least("component", "_next").alias("component"), "_old"
            )
        )
        changed = jumped.filter(F.col("component") != F.col("_old")).limit(1).count()
        labels = jumped.drop("_old")
        if not changed:
            return labels


def density_clusters(
    df: DataFrame, row_id: str, point: str, cell: float, min_points: int, min_size: int, dimensions: int
) -> DataFrame:
    """(id, cluster): clusters numbered from 0 by size, -1 for noise and for clusters below ``min_size``."""
    at = [F.floor(F.get(F.col(point), F.lit(i)) / cell).cast("long") for i in range(dimensions)]
    placed = durable(df.select(row_id, F.array(*at).alias("cell")))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"))
    dense = durable(cells.filter(F.col("n") >= min_points).select(F.col("cell").alias("node")))

    steps = [s for s in product((-1, 0, 1), repeat=dimensions) if any(s)]
    beside = F.array(*[F.array(*[F.lit(x).cast("long") for x in s]) for s in steps])

    def neighbours(cell_name: str):
        return F.explode(F.transform(beside, lambda s: F.zip_with(F.col(cell_name), s, lambda a, b: a + b)))

    touching = dense.select(F.col("node").alias("src"), neighbours("node").alias("dst"))
    edges = touching.join(dense, touching["dst"] == dense["node"], "left_semi")
    parts = components(edges, dense)

    sparse = cells.filter(F.col("n") < min_points).select("cell", neighbours("cell").alias("node"))
    border = sparse.join(parts, "node").groupBy("cell").agg(F.min("component").alias("component"))
    cell_parts = reduce(DataFrame.unionByName, [parts.withColumnRenamed("node", "cell"), border])

    sizes = cells.join(cell_parts, "cell").groupBy("component").agg(F.sum("n").alias("size"))
    kept = sizes.filter(F.col("size") >= min_size)
    by_size = kept.select((-F.col("size")).alias("_order"), "component")
    numbered = dense_position(by_size, [], ["_order", "component"], "cluster")
    named = cell_parts.join(numbered, "component").select("cell", F.col("cluster").cast("int"))
    return placed.join(named, "cell", "left").select(row_id, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def cluster_name(cluster: Column, names: Mapping[int, str], default: Column) -> Column:
    """Name of a cluster number, noise (-1) included."""
    label = default
    for number, name in names.items():
        label = F.when(cluster == number, F.lit(name)).otherwise(label)
    return label


def cluster_sizes(labelled: DataFrame, cluster: str) -> DataFrame:
    """Count and share of each cluster, noise included."""
    total = labelled.agg(F.count("*")).scalar()
    counted = labelled.groupBy(cluster).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / total, 6))
