"""Spanning forests and the density hierarchy against plain versions that work top down on whole arrays."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from activity_engine.operators import forest, hierarchy


def frame(spark, points, offset=0):
    return spark.createDataFrame(pd.DataFrame({"id": range(offset, offset + len(points)), "v": points.tolist()})).repartition(4)


def plain_edges(points, counts, min_samples, neighbours):
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    near = [[j for j in np.argsort(row, kind="stable") if j != i][:neighbours] for i, row in enumerate(far)]
    core = []
    for i, js in enumerate(near):
        have, at = counts[i] - 1, 0.0
        for j in js:
            if have >= min_samples:
                break
            have, at = have + counts[j], far[i, j]
        core.append(at)
    return sorted({(max(far[i, j], core[i], core[j]), min(i, j), max(i, j)) for i, js in enumerate(near) for j in js})


def plain_forest(n, edges):
    above = list(range(n))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    out = []
    for w, a, b in edges:
        if top(a) != top(b):
            above[top(b)] = top(a)
            out.append((w, a, b))
    return out, [top(i) for i in range(n)]


def plain_clusters(counts, tree_edges, trees, min_size):
    """Top down: remove the heaviest edge of a component and look at both sides. Returns a set of nodes for each kept cluster."""
    floor = hierarchy.LEAST_DISTANCE

    def sides(nodes, edges):
        own = plain_forest(len(counts), edges)[1]
        groups = {}
        for i in nodes:
            groups.setdefault(own[i], set()).add(i)
        return list(groups.values())

    size = lambda nodes: sum(counts[i] for i in nodes)

    def open_(nodes, edges, birth):
        """(stability, value, kept) of the cluster that begins at ``birth`` with these nodes."""
        everything, mass = set(nodes), 0.0
        while edges:
            (w, _, _), edges = edges[-1], edges[:-1]
            density = 1 / max(w, floor)
            two = sides(nodes, edges)
            big = [s for s in two if size(s) >= min_size]
            if len(big) == 2:
                mass += size(nodes) * density
                below = [open_(s, [e for e in edges if e[1] in s], density) for s in big]
                best = sum(b[1] for b in below)
                own = mass - size(everything) * birth
                kept = [everything] if own >= best else [c for b in below for c in b[2]]
                return own, max(own, best), kept
            if not big:
                mass += size(nodes) * density
                nodes, edges = set(), []
                break
            mass += size(nodes - big[0]) * density
            nodes, edges = big[0], [e for e in edges if e[1] in big[0]]
        mass += size(nodes) / floor
        own = mass - size(everything) * birth
        return own, max(own, 0.0), [everything] if own >= 0 else []

    roots = [s for s in sides(range(len(counts)), tree_edges) if size(s) >= min_size]
    if len(roots) > 1:
        return [c for s in roots for c in open_(s, [e for e in tree_edges if e[1] in s], 0.0)[2]]
    if not roots:
        return []
    nodes, edges = roots[0], [e for e in tree_edges if e[1] in roots[0]]
    while edges:  # down to where the only root parts in two
        (w, _, _), edges = edges[-1], edges[:-1]
        big = [s for s in sides(nodes, edges) if size(s) >= min_size]
        if len(big) == 2:
            return [c for s in big for c in open_(s, [e for e in edges if e[1] in s], 1 / max(w, floor))[2]]
        if not big:
            return []
        nodes, edges = big[0], [e for e in edges if e[1] in big[0]]
    return []


def plain(points, min_samples, min_size, neighbours):
    distinct, first, place, counts = np.unique(points, axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)  # nodes by their first row
    rank = np.argsort(order)
    counts = counts[order].tolist()
    edges = plain_edges(distinct[order], counts, min_samples, neighbours)
    tree_edges, trees = plain_forest(len(counts), edges)
    node = rank[place.reshape(-1)]
    kept = plain_clusters(counts, tree_edges, trees, min_size)
    rows = sorted((sorted(np.flatnonzero(np.isin(node, list(c))).tolist()) for c in kept), key=lambda c: (-len(c), c))
    return {i: n for n, c in enumerate(rows) for i in c}


def unlike_densities(seed=0):
    """A tight and a loose cluster, two that touch, a heap of copies, and scattered rows."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, .05, (60, 3)), rng.normal(4, .6, (70, 3)), rng.normal([9, 0, 0], .2, (40, 3)), rng.normal([10, 0, 0], .2, (40, 3)),
             np.tile([[20., 20., 20.]], (30, 1)), rng.uniform(-15, 25, (25, 3))]
    points = np.concatenate(parts)
    return points[rng.permutation(len(points))]


@pytest.mark.parametrize("part_edges, neighbours", [(1000, 6), (12, 6), (40, 12)])
def test_against_top_down(spark, part_edges, neighbours):
    points = unlike_densities()
    found = hierarchy.density_hierarchy(frame(spark, points), "id", "v", 5, 20, neighbours, part_edges).collect()
    expected = plain(points, 5, 20, neighbours)
    assert {r.id: r.cluster for r in found} == {i: expected.get(i, -1) for i in range(len(points))}
    assert len(set(expected.values())) >= 4 and len(expected) < len(points)


def test_clusters_of_unlike_density_are_found(spark):
    """With all distances known, one cut could not find both the tight cluster and the loose one."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(0, .02, (80, 4)), rng.normal(3, .5, (80, 4)), rng.uniform(-8, 8, (20, 4))])
    found = {r.id: r.cluster for r in hierarchy.density_hierarchy(frame(spark, points), "id", "v", 5, 30, 30).collect()}
    tight, loose, noise = (Counter(found[i] for i in ids).most_common(1)[0] for ids in (range(80), range(80, 160), range(160, 180)))
    assert tight[0] != loose[0] and -1 not in (tight[0], loose[0]) and noise[0] == -1
    assert tight[1] >= 75 and loose[1] >= 65 and noise[1] >= 15


def test_forest(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(float(w), int(min(a, b)), int(max(a, b))) for w, a, b in zip(rng.integers(0, 9, 400), *rng.integers(0, 150, (2, 400))) if a != b}
                   | {(1., i, i + 1) for i in range(200, 260)})
    edges = [e for i, e in enumerate(edges) if (e[1], e[2]) not in {(x[1], x[2]) for x in edges[:i]}]
    expected, trees = plain_forest(270, edges)
    found, labels = forest.spanning_forest(spark.range(270).withColumnRenamed("id", "node"), spark.createDataFrame([(a, b, w) for w, a, b in edges], "a long, b long, w double"))
    assert sorted((r.w, r.a, r.b) for r in found.collect()) == expected
    mine = {r.node: r.tree for r in labels.collect()}
    assert len(mine) == 270 and len(set(zip(mine.values(), (trees[i] for i in mine)))) == len(set(trees)) == len(set(mine.values()))


def test_odd_tables(spark):
    none = spark.createDataFrame([(1, None), (2, []), (3, [float("nan"), 1.]), (4, [1., None])], "id int, v array<double>")
    assert {r.cluster for r in hierarchy.density_hierarchy(none, "id", "v", 2, 3, 4).collect()} == {-1}
    assert hierarchy.density_hierarchy(none.where("false"), "id", "v", 2, 3, 4).count() == 0
    copies = spark.createDataFrame([(i, [1., 2.]) for i in range(9)] + [(i, [5., 5.]) for i in range(20, 26)] + [(50, [1., 2., 3.])], "id int, v array<double>")
    found = {r.id: r.cluster for r in hierarchy.density_hierarchy(copies, "id", "v", 2, 5, 4).collect()}
    assert found == {**dict.fromkeys(range(9), 0), **dict.fromkeys(range(20, 26), 1), 50: -1}
    with pytest.raises(ValueError):
        hierarchy.density_hierarchy(copies, "id", "v", 5, 5, 4)
