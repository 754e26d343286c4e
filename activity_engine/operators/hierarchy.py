"""Density clusters from a hierarchy: neighbour graph, spanning forest over mutual reachability, cut by size and stability.

1. Rows with one vector are one node that counts as many. Every node has its nearest ``neighbours`` nodes (exact).
2. Its core distance is that to the ``min_samples``-th other row. An edge weighs the greatest of its length and both cores.
3. A minimum spanning forest of that graph holds all there is to know about what is connected at any distance.
4. Taking the forest's edges by weight, sets of nodes merge. Where both have ``min_size`` rows, two clusters end and their parent
   begins; a smaller set only adds its rows to the cluster it meets, at that distance; sets without a cluster become one on
   reaching ``min_size`` rows. A cluster's stability is the sum, over its rows, of how much denser (1 / distance) they
   joined it than it ended.
5. From the leaves up, a cluster is kept if it is at least as stable as the best choice among its descendants. Where only one tree of
   the forest has ``min_size`` rows, its root stands for everything and is not kept. Rows outside kept clusters are noise.

Step 4 is a sequence over all edges of a tree. Trees with more than ``part_edges`` edges are cut at their median edge: below it
lie components of their own, each a part; above it the rest, where every such component is one leaf whose size is known. That
repeats until all parts are small, and all parts are then worked on at the same time; nothing is handed from one to another
but names. Components below ``min_size`` are never opened.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_engine.operators.forest import follow, spanning_forest
from activity_engine.operators.nearest import GROUP_BYTES, Search
from activity_engine.operators.ordered import dense_position
from activity_engine.session import written

MIN_SAMPLES, MIN_SIZE, NEIGHBOURS = 5, 60, 16
PART_EDGES = 200_000
#: Distances below this count as this, so that copies are very dense, not infinitely.
LEAST_DISTANCE = 1e-9


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Unique numbers that grow with ``order``."""
    return written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def neighbour_edges(nodes: DataFrame, min_samples: int, neighbours: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(a, b, w) with a < b: each node (node, n, vector) and its nearest nodes, by mutual reachability."""
    found = Search(nodes, "node", "vector", "euclid", group_bytes)(nodes, "node", "vector", neighbours + 1).matches
    near = found.select(F.col("row").alias("a"), F.posexplode("matches").alias("place", "m")).select(
        "a", F.col("m.ref").alias("b"), F.sqrt("m.loss").alias("d")).where("a <> b")
    size = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    listed = written(near.join(size, "b").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d", "b", "nb"))).alias("near")))
    own = nodes.select(F.col("node").alias("a"), "n")
    start = F.struct((F.col("n") - 1).alias("have"), F.lit(0.0).alias("at"))

    def step(state: Column, other: Column) -> Column:
        enough = state["have"] >= min_samples
        return F.struct((state["have"] + other["nb"]).alias("have"), F.when(enough, state["at"]).otherwise(other["d"]).alias("at"))

    cores = written(listed.join(own, "a").select("a", F.aggregate("near", start, step)["at"].alias("core")))
    edges = listed.select("a", F.explode("near").alias("e")).select("a", "e.b", "e.d")
    edges = edges.join(cores.withColumnRenamed("core", "core_a"), "a").join(
        cores.select(F.col("a").alias("b"), F.col("core").alias("core_b")), "b")
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.max(F.greatest("d", "core_a", "core_b")).alias("w"))


# Leaves of parts: node i is -1 - i, the component that edge number r completes is r.

_OUT = "kind string, name long, cluster long, n long, amount double"


def _part(min_size: int):
    def run(edges: pa.Table, leaves: pa.Table) -> pa.Table:
        """One part: its merges, the mass of its clusters, which cluster its leaves belong to, and how it ends.

        ``merge``: cluster ``name`` ends in ``cluster``, with n rows, at a density. ``mass``: rows times density. ``member``: leaf
        ``name`` joins ``cluster``. ``end`` (``root``): component (tree) ``name`` ends as ``cluster``. A big leaf is the cluster named like it.
        """
        out: list[tuple] = []
        mass: dict[int, float] = defaultdict(float)
        size = dict(zip(leaves.column("leaf").to_pylist(), leaves.column("n").to_pylist()))
        above = {leaf: leaf for leaf in size}
        cluster = {leaf: leaf if n >= min_size else None for leaf, n in size.items()}
        waiting = {leaf: [leaf] for leaf, n in size.items() if n < min_size}
        for leaf, n in size.items():
            if n >= min_size and leaf < 0:  # a node of so many copies is a cluster by itself
                mass[leaf] += n / LEAST_DISTANCE
                out.append(("member", leaf, leaf, n, None))

        def top(leaf: int) -> int:
            while above[leaf] != leaf:
                above[leaf] = above[above[leaf]]
                leaf = above[leaf]
            return leaf

        edges = edges.take(pc.sort_indices(edges, [("r", "ascending")]))
        for r, u, v, w in zip(*(edges.column(c).to_pylist() for c in ("r", "u", "v", "w"))):
            a, b = top(u), top(v)
            if size[a] < size[b]:
                a, b = b, a
            density, total = 1 / max(w, LEAST_DISTANCE), size[a] + size[b]
            ca, cb = cluster[a], cluster[b]
            if ca is not None and cb is not None:
                out += [("merge", ca, r, size[a], density), ("merge", cb, r, size[b], density)]
                mass[r] += total * density
                cluster[a] = r
            else:
                fallen = waiting.pop(b, [])
                if ca is None:
                    fallen = waiting.pop(a) + fallen
                    if total < min_size:
                        waiting[a], fallen = fallen, []
                    else:
                        cluster[a] = r
                        mass[r] += total * density
                else:
                    mass[ca] += size[b] * density
                out += [("member", leaf, cluster[a], size[leaf], None) for leaf in fallen]
            above[b], size[a] = a, total
        end = top(next(iter(above))) if above else None
        part = (leaves.column("part")[0] if leaves.num_rows else edges.column("part")[0]).as_py()
        if end is not None and cluster[end] is not None:
            out.append(("end" if part >= 0 else "root", part, cluster[end], size[end], None))
        out += [("mass", c, c, 0, m) for c, m in mass.items()]
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "name", "cluster", "n", "amount"])

    return run


def _split(edges: DataFrame, leaves: DataFrame, belongs: DataFrame, large: DataFrame, min_size: int):
    """Cut the ``large`` parts at their median edge. Returns the new (edges, leaves, belongs)."""
    pivots = edges.join(large, "part").groupBy("part").agg(F.percentile_approx("r", 0.5, 1000).alias("pivot"))
    # at most a row for every ``part_edges`` edges
    marked = written(edges.join(F.broadcast(pivots), "part", "left").withColumn("low", F.coalesce(F.col("r") <= F.col("pivot"), F.lit(False))).drop("pivot"))
    low = marked.where("low").select("part", "r", "u", "v", "w")
    ends = low.select(F.col("u").alias("node")).union(low.select(F.col("v").alias("node"))).distinct()
    pairs = low.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.lit(0.0).alias("w"))
    _, trees = spanning_forest(ends, pairs)
    named = low.join(trees, low["u"] == trees["node"]).groupBy("tree").agg(F.max("r").alias("comp"))
    inside = written(trees.join(named, "tree").select(F.col("node").alias("leaf"), "comp"))
    held = leaves.join(inside, "leaf", "left")
    sizes = written(held.where("comp is not null").groupBy("part", "comp").agg(F.sum("n").alias("n")))
    big = sizes.where(F.col("n") >= min_size).select("comp")
    kept = low.join(inside, low["u"] == inside["leaf"]).join(big, "comp", "left_semi").select(F.col("comp").alias("part"), "r", "u", "v", "w")
    rest = marked.where("not low").select("part", "r", "u", "v", "w")
    for column in ("u", "v"):
        at = inside.select(F.col("leaf").alias(column), "comp")
        rest = rest.join(at, column, "left").withColumn(column, F.coalesce("comp", column)).drop("comp")
    within = held.where("comp is not null").join(big, "comp", "left_semi").select(F.col("comp").alias("part"), "leaf", "n")
    outside = held.where("comp is null").select("part", "leaf", "n").unionByName(sizes.select("part", F.col("comp").alias("leaf"), "n"))
    small = inside.join(sizes.where(F.col("n") < min_size).select("comp"), "comp", "left_semi").select(F.col("leaf").alias("at"), F.col("comp").alias("to"))
    belongs = belongs.join(small, belongs["leaf"] == small["at"], "left").select("node", F.coalesce("to", "leaf").alias("leaf"))
    return written(kept.unionByName(rest.select(*kept.columns))), written(within.unionByName(outside)), written(belongs)


def _stable(merges: DataFrame, masses: DataFrame, roots: DataFrame) -> DataFrame:
    """(cluster, kept): the cluster to which the rows of each cluster go in the end, null for noise."""
    alone = roots.limit(2).count() == 1
    tree = merges.unionByName(roots.select("cluster", F.lit(None).cast("long").alias("parent"), "n", F.lit(0.0).alias("density")))
    stability = F.col("mass") - F.col("n") * F.col("density")
    open_ = written(tree.join(masses, "cluster").select(
        "cluster", "parent", F.when(F.col("parent").isNull() & F.lit(alone), F.lit(-1.0)).otherwise(stability).alias("own"), F.lit(0.0).alias("below")))
    done = None
    while open_.limit(1).count():  # as many rounds as the hierarchy of clusters is high
        leaves = open_.join(open_.select(F.col("parent").alias("cluster")).where("cluster is not null").distinct(), "cluster", "left_anti")
        ready = written(leaves.withColumn("chosen", F.col("own") >= F.col("below")))
        done = ready if done is None else done.unionByName(ready)
        given = ready.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.greatest("own", "below")).alias("more"))
        open_ = written(open_.join(ready.select("cluster"), "cluster", "left_anti").join(given, "cluster", "left").select(
            "cluster", "parent", "own", (F.col("below") + F.coalesce("more", F.lit(0.0))).alias("below")))
    if done is None:
        return masses.select("cluster", F.lit(None).cast("long").alias("kept")).where("false")
    # The topmost chosen ancestor: every round looks twice as far up.
    state = written(done.select("cluster", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("cluster")).alias("kept")))
    while state.where("up is not null").limit(1).count():
        ahead = state.select(F.col("cluster").alias("up"), F.col("up").alias("__up"), F.col("kept").alias("__kept"))
        state = written(state.join(ahead, "up", "left").select("cluster", F.col("__up").alias("up"), F.coalesce("__kept", "kept").alias("kept")))
    return state.select("cluster", "kept")


def clusters_of(nodes: DataFrame, edges: DataFrame, min_size: int = MIN_SIZE, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, cluster) of all nodes (node, n) by the edges (a, b, w); cluster is null for noise."""
    forest, trees = spanning_forest(nodes, edges)
    ranked = _numbered(forest, ["w", "a", "b"], "r")
    label = lambda node: (-1 - F.col(node))
    parts = ranked.join(trees, ranked["a"] == trees["node"]).select(label("tree").alias("part"), "r", label("a").alias("u"), label("b").alias("v"), "w")
    counted = nodes.select("node", "n").join(trees, "node")
    large_trees = counted.groupBy("tree").agg(F.sum("n").alias("rows")).where(F.col("rows") >= min_size).select("tree")
    leaves = written(counted.join(large_trees, "tree", "left_semi").select(label("tree").alias("part"), label("node").alias("leaf"), "n"))
    parts = written(parts.join(leaves.select("part").distinct(), "part", "left_semi"))
    belongs = written(nodes.select("node", label("node").alias("leaf")))
    while True:
        large = parts.groupBy("part").agg(F.count("*").alias("edges")).where(F.col("edges") > part_edges).select("part")
        large = written(large)
        if not large.limit(1).count():
            break
        parts, leaves, belongs = _split(parts, leaves, belongs, large, min_size)
    done = written(parts.groupBy("part").cogroup(leaves.groupBy("part")).applyInArrow(_part(min_size), _OUT))

    # A component that is a leaf elsewhere is there named by itself; here it is known as which cluster it ended.
    ends = follow(done.where("kind = 'end' and name <> cluster").select(F.col("name").alias("at"), F.col("cluster").alias("to")))

    def known(rows: DataFrame, column: str) -> DataFrame:
        at = ends.select(F.col("at").alias(column), "to")
        return rows.join(at, column, "left").withColumn(column, F.coalesce("to", column)).drop("to")

    merges = known(done.where("kind = 'merge'").select(F.col("name").alias("cluster"), F.col("cluster").alias("parent"), "n", F.col("amount").alias("density")), "cluster")
    masses = known(done.where("kind = 'mass'").select("cluster", "amount"), "cluster").groupBy("cluster").agg(F.sum("amount").alias("mass"))
    roots = written(known(done.where("kind = 'root'").select("cluster", "n"), "cluster"))
    kept = _stable(merges, written(masses), roots)
    members = known(done.where("kind = 'member'").select(F.col("name").alias("leaf"), "cluster"), "cluster").join(kept, "cluster", "left")
    return belongs.join(members.select("leaf", F.col("kept").alias("cluster")), "leaf", "left").select("node", "cluster")


def density_hierarchy(
    df: DataFrame, row_id: str, vector: str, min_samples: int = MIN_SAMPLES, min_size: int = MIN_SIZE,
    neighbours: int = NEIGHBOURS, part_edges: int = PART_EDGES, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(id, cluster) of all rows: clusters numbered from 0 by size (equal ones by their least id), -1 for noise and for rows
    whose vector is null, empty, of an uncommon length, or holds null or NaN."""
    if neighbours < min_samples:
        raise ValueError("neighbours below min_samples: core distances would not be known")
    rows = written(df.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("vector")))
    usable = rows.where((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    width = usable.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    usable = usable.where(F.size("vector") == (width.width if width else 0))
    same = usable.groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    nodes = _numbered(same, ["first"], "node")
    labels = written(clusters_of(nodes, neighbour_edges(nodes, min_samples, neighbours, group_bytes), min_size, part_edges))
    told = nodes.join(labels.where("cluster is not null"), "node")
    sizes = told.groupBy("cluster").agg((-F.sum("n")).alias("_order"), F.min("first").alias("_first"))
    numbers = dense_position(sizes, [], ["_order", "_first"], "number").select("cluster", "number")
    placed = told.join(numbers, "cluster").select("vector", F.col("number").cast("int").alias("cluster"))
    return rows.join(placed, "vector", "left").select(F.col("id").alias(row_id), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
