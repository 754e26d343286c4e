"""Ordered operators against plain pandas, with one key holding a third of the rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from activity_engine.operators import ordered


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    keys = [0] * 400 + [rng.randint(1, 60) for _ in range(800)]
    data = [(k, rng.randint(0, 500), i, rng.choice("AAB"), rng.choice([None, 1, 2, 3])) for i, k in enumerate(keys)]
    return pd.DataFrame(data, columns=["k", "t", "id", "kind", "v"]).sort_values(["k", "t", "id"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(
        [tuple(None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in r) for r in rows.itertuples(index=False)],
        "k int, t int, id int, kind string, v int")


def collected(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_big_key_is_spread_over_chunks(frame):
    placed = ordered.OrderedRows(frame, ["k"], ["t", "id"], chunks=12).df
    sizes = placed.groupBy(ordered.CHUNK).count().toPandas()["count"]
    assert placed.filter("k = 0").select(ordered.CHUNK).distinct().count() >= 3
    assert sizes.max() < 400


def test_lag_and_running_sum(frame, rows):
    made = ordered.OrderedRows(frame, ["k"], ["t", "id"], chunks=12)
    got = collected(made.lag(F.col("t"), "before").running_sum(F.col("t").cast("long"), "total").row_number("n").result(), "before", "total", "n")
    group = rows.groupby("k")
    before, total, n = group["t"].shift(), group["t"].cumsum(), group.cumcount() + 1
    for i, row in rows.iterrows():
        assert got[row["id"]] == (None if pd.isna(before[i]) else int(before[i]), total[i], n[i])


def test_last_and_next_known(frame, rows):
    made = ordered.OrderedRows(frame, ["k"], ["t", "id"], chunks=12)
    got = collected(made.last_known(F.col("v"), "last").next_known(F.col("v"), "next").result(), "last", "next")
    last, following = rows.groupby("k")["v"].ffill(), rows.groupby("k")["v"].bfill()
    for i, row in rows.iterrows():
        assert got[row["id"]] == tuple(None if pd.isna(x[i]) else int(x[i]) for x in (last, following))


@pytest.mark.parametrize("size", [1, 3, 40])
def test_preceding(frame, rows, size):
    got = collected(ordered.OrderedRows(frame, ["k"], ["t", "id"], chunks=12).preceding(F.col("id"), size, "p").result(), "p")
    for _, part in rows.groupby("k"):
        ids = part["id"].tolist()
        for i, row_id in enumerate(ids):
            assert got[row_id][0] == ids[max(0, i - size):i]


def test_runs(frame, rows):
    got = collected(ordered.number_runs(frame, ["k"], ["t", "id"], "kind"), "run_no")
    for _, part in rows.groupby("k"):
        run, before = 0, None
        for _, row in part.iterrows():
            run += before is not None and row["kind"] != before
            before = row["kind"]
            assert got[row["id"]] == (run,)


def test_runs_of_a_short_sequence(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate("AABA")] + [(2, 0, "A")], "k int, t int, s string")
    got = {(r["k"], r["t"]): r["run_no"] for r in ordered.number_runs(df, ["k"], ["t"], "s").collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 0): 0}


def test_percent_rank_with_and_without_keys(frame, rows):
    for keys in (["k"], []):
        got = collected(ordered.percent_rank(frame.select("k", "id", "t"), keys, "t", "p"), "p")
        for _, part in rows.groupby("k") if keys else [(None, rows)]:
            low = part["t"].rank(method="min") - 1
            for i in part.index:
                assert got[rows["id"][i]][0] == pytest.approx(low[i] / (len(part) - 1) if len(part) > 1 else 0.0)


def test_positions_start_at_zero(frame, rows):
    got = collected(ordered.dense_position(frame, ["k"], ["t", "id"]), "rank")
    assert got == {row_id: (n,) for row_id, n in zip(rows["id"], rows.groupby("k").cumcount())}
