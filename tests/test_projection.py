"""Principal axes against NumPy's decomposition."""

import numpy as np
import pandas as pd

from activity_engine.operators import projection


def data(n=400, width=40, seed=2):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, width)) * (1.3 ** -np.arange(width)) @ np.linalg.qr(rng.normal(size=(width, width)))[0] + 3


def frame(spark, matrix):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(matrix)), "v": matrix.tolist()})).repartition(3)


def exact(matrix, k):
    _, s, vt = np.linalg.svd(matrix - matrix.mean(axis=0), full_matrices=False)
    return vt[:k].T, (s ** 2 / (s ** 2).sum())[:k]


def test_axes(spark):
    matrix = data()
    found = projection.principal_axes(frame(spark, matrix), "v", 8)
    axes, share = exact(matrix, 8)
    assert np.abs(found.explained - share).max() < 1e-3 and abs(found.explained.sum() - share.sum()) < .01 * share.sum()
    angles = np.arccos(np.clip(np.linalg.svd(found.axes.T @ axes)[1], -1, 1))
    assert angles.max() < .02 and np.abs(found.axes.T @ found.axes - np.eye(8)).max() < 1e-9
    made = sorted((r.id, r.projected) for r in found.project(frame(spark, matrix), "v").collect())
    assert np.abs(np.array([p for _, p in made]) - (matrix - matrix.mean(axis=0)) @ found.axes).max() < 1e-9


def test_all_axes_and_wanted_variance(spark):
    matrix = data(width=12)
    found = projection.principal_axes(frame(spark, matrix), "v", 50)
    _, share = exact(matrix, 12)
    assert found.axes.shape == (12, 12) and np.abs(found.explained - share).max() < 1e-9
    k = found.first(variance=.9).axes.shape[1]
    assert share[:k].sum() >= .9 > share[:k - 1].sum() and found.first(3).axes.shape == (12, 3)


def test_odd_vectors(spark):
    rows = [(i, [float(i), 2. * i, 1.]) for i in range(10)] + [(20, None), (21, []), (22, [1.]), (23, [1., None, 2.]), (24, [float("inf"), 0., 0.])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    found = projection.principal_axes(df, "v", 2)
    assert abs(found.explained[0] - 1) < 1e-9 and np.abs(found.axes[:, 0] - np.array([1, 2, 0]) / 5 ** .5).max() < 1e-9
    assert {r.id: len(r.projected) for r in found.project(df, "v").collect()} == {**dict.fromkeys(range(10), 2), 20: 0, 21: 0, 22: 0, 23: 0, 24: 0}
    none = projection.principal_axes(df.where("false"), "v", 2)
    assert none.axes.size == 0 and none.project(df.where("false"), "v").count() == 0
