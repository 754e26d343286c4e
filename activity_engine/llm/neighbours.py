"""Nearest neighbours by few stable projections, a kd-tree over them, and a chi-square stopping test.

Unit vectors are projected on ``DIMENSIONS`` Gaussian directions. The squared projected distance of two vectors is their
squared distance times a chi-square variable, so a vector nearer than r has a projection within r * sqrt(quantile) with
the probability of the quantile. Projected neighbours are therefore verified in the order of their distance until the
next one is too far for the nearest found so far, at probability ``SURE`` for each neighbour.

The upper levels of the kd-tree are fitted on a bounded sample and deal all vectors into cells of about ``CELL``; every
cell builds the rest over all its vectors. A query first searches its own cell. What it finds there bounds the cells it
must visit next. Equal vectors are held once, with as many of their ids as can be asked for.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from activity_engine.session import durable

DIMENSIONS = 8
SURE = 0.99
CELL = 16_384
LEAF = 256
#: Vectors that the upper levels of the tree are fitted on, at most about.
SAMPLE = 10_000
K = 5
EVERY = 50
_FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, dimensions: int) -> float:
    """By bisection on the regularised lower gamma series."""
    def below(x: float) -> float:
        a, term, total = dimensions / 2, 1.0, 1.0
        for i in range(1, 500):
            term *= x / 2 / (a + i)
            total += term
        return total * math.exp(a * math.log(x / 2) - x / 2 - math.lgamma(a + 1)) if x else 0.0

    low, high = 0.0, 200.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def directions(size: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(20250607).standard_normal((size, dimensions))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def in_range(vectors: np.ndarray) -> np.ndarray:
    """Rows whose squares a double cannot hold are scaled by a power of two, which no cosine feels; others are as they were."""
    if not vectors.size:
        return vectors
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    odd = np.abs(exponent) > 400
    return np.where(odd[:, None], np.ldexp(vectors, -exponent[:, None]), vectors) if odd.any() else vectors


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return in_range(flat.reshape(len(lists), -1).astype(float)) if len(lists) else np.zeros((0, 1))


class Planes:
    """Upper levels of the kd-tree as a heap: node i splits axis[i] at cut[i]; leaves are cells, with their boxes."""

    def __init__(self, points: np.ndarray, cells: int):
        self.depth = max(0, math.ceil(math.log2(max(1, cells))))
        count = (1 << self.depth) - 1
        self.axis, self.cut = np.zeros(count, np.int64), np.zeros(count)
        self.low = np.full((1 << self.depth, DIMENSIONS), -np.inf)
        self.high = np.full((1 << self.depth, DIMENSIONS), np.inf)
        held = {0: points}
        for node in range(count):
            mine = held.pop(node)
            if len(mine):
                self.axis[node] = int(np.argmax(np.ptp(mine, axis=0)))
                self.cut[node] = float(np.median(mine[:, self.axis[node]]))
            left = mine[:, self.axis[node]] < self.cut[node]
            held[2 * node + 1], held[2 * node + 2] = mine[left], mine[~left]
            level = int(math.log2(node + 1))
            width = 1 << (self.depth - level)
            first = (node + 1 - (1 << level)) * width
            axis = self.axis[node]
            self.high[first: first + width // 2, axis] = np.minimum(self.high[first: first + width // 2, axis], self.cut[node])
            self.low[first + width // 2: first + width, axis] = np.maximum(self.low[first + width // 2: first + width, axis], self.cut[node])

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] >= self.cut[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)

    def distance(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance from a point to the box of every cell."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


class Tree:
    """kd-tree over the projections of one cell: leaves of at most ``LEAF`` rows with their boxes."""

    def __init__(self, points: np.ndarray):
        leaves, todo = [], [np.arange(len(points))] if len(points) else []
        while todo:
            rows = todo.pop()
            spread = np.ptp(points[rows], axis=0)
            if len(rows) <= LEAF or not spread.any():
                leaves.append(rows)
                continue
            axis = int(np.argmax(spread))
            half = len(rows) // 2
            order = rows[np.argpartition(points[rows, axis], half)]
            todo += [order[:half], order[half:]]
        self.leaves = leaves
        self.low = np.array([points[r].min(axis=0) for r in leaves]).reshape(-1, points.shape[1])
        self.high = np.array([points[r].max(axis=0) for r in leaves]).reshape(-1, points.shape[1])

    def nearest_first(self, point: np.ndarray):
        """(least squared projected distance of what is left, rows) leaf by leaf."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        distance = (gap * gap).sum(axis=1)
        for leaf in np.argsort(distance, kind="stable"):
            yield distance[leaf], self.leaves[leaf]


def _excluded(least: float, bound: float, quantile: float) -> bool:
    """Chi-square test: nothing at projected distance ``least`` or more is likely to be nearer than ``bound`` (squared)."""
    return least > bound * quantile


def _search(k: int, quantile: float, size: int):
    project = directions(size)

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        vectors = matrix(points.column("embedding"))
        members = points.column("members").to_pylist()
        normal = unit(vectors) if len(vectors) else vectors
        tree = Tree(normal @ project) if len(vectors) else None
        length = np.linalg.norm(vectors, axis=1) if len(vectors) else np.zeros(0)
        out: list[tuple[int, int, float]] = []
        asked = matrix(queries.column("embedding"))
        for query, vector, bound in zip(queries.column("query_id").to_pylist(), asked, queries.column("bound").to_pylist()):
            best: list[tuple[float, int]] = []
            limit = math.inf if bound is None else bound
            norm = np.linalg.norm(vector)
            for least, rows in tree.nearest_first(vector / norm @ project) if tree else ():
                if _excluded(least, limit, quantile):
                    break
                score = vectors[rows] @ vector / (length[rows] * norm)
                worst = best[-1][0] if len(best) == k else math.inf
                for row in np.flatnonzero(-score <= worst):
                    best += [(-float(score[row]), m) for m in members[rows[row]] if m != query]
                best = sorted(best)[:k]
                if len(best) == k:
                    limit = min(limit, 2 + 2 * best[-1][0] + 1e-12)
            out += [(query, m, -s) for s, m in best]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, sure: float = SURE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose ``vec_id`` is divisible by ``every``, its ``k`` nearest others by
    cosine, nearest first, ties to the smaller id.

    Rows whose vector is null, empty, zero, or holds null or non-finite components take no part, nor do rows without an
    id. Vectors of each length are an index of their own, built one after another. Of repeated rows of one id the least vector
    counts. Each neighbour is found with a probability of about ``sure``. An empty table gives no rows.
    """
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where("vec_id is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(fine)
    shapes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()  # a row a length
    if len(shapes) > 1:  # an id counts once, with its least vector
        rows = durable(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    found = [_nearest(rows, s["size"], s["n"], k, every, sure) for s in shapes or [{"size": 1, "n": 0}]]
    return reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, size: int, count: int, k: int, every: int, sure: float) -> DataFrame:
    """``nearest`` among the vectors of one length."""
    rows = rows.where(F.size("embedding") == size).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    first = Window.partitionBy("embedding").orderBy("vec_id")
    held = durable(rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
                   .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("members")))
    share = min(1.0, SAMPLE / max(1, count))
    sample = held.where(F.pmod(F.xxhash64("embedding"), F.lit(1_000_000)) < int(share * 1_000_000)).select("embedding").collect()
    project = directions(size)
    points = unit(in_range(np.array([r.embedding for r in sample]).reshape(-1, size))) @ project if sample else np.zeros((0, DIMENSIONS))
    planes = Planes(points, count // CELL)
    quantile = chi_square_quantile(sure, DIMENSIONS)

    @F.arrow_udf("int")
    def cell_of(column: pa.Array) -> pa.Array:
        return pa.array(planes.cell(unit(matrix(column)) @ project).astype(np.int32)) if len(column) else pa.array([], pa.int32())

    @F.arrow_udf("array<int>")
    def cells_within(column: pa.Array, bound: pa.Array) -> pa.Array:
        out = []
        for point, most in zip(unit(matrix(column)) @ project if len(column) else (), bound.to_pylist()):
            near = ~np.array([_excluded(d, math.inf if most is None else most, quantile) for d in planes.distance(point)])
            near[planes.cell(point[None])[0]] = False
            out.append(np.flatnonzero(near).astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    index = held.withColumn("cell", cell_of("embedding"))
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    search = _search(k, quantile, size)

    def searched(queries: DataFrame) -> DataFrame:
        return index.groupBy("cell").cogroup(queries.groupBy("cell")).applyInArrow(search, _FOUND)

    own = durable(searched(asked.withColumn("cell", cell_of("embedding")).withColumn("bound", F.lit(None).cast("double"))))
    reached = own.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select(
        "query_id", (2 - 2 * F.col("least") + 1e-12).alias("bound"))
    wider = asked.join(reached, "query_id", "left").withColumn("cell", F.explode(cells_within("embedding", "bound")))
    return _best(own.unionByName(searched(wider)), k).select("query_id", "rank", "vec_id", "score")
