"""What only shows on larger tables: which side of a join is sent around, and counts that must stay exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from activity_engine import session
from activity_engine.operators import lookups, nearest, profiles, sketches, terms, vectors
from activity_engine.plans import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [100_000, 0])
def test_pieces_of_titles_are_never_sent_around(spark, monkeypatch, few):
    monkeypatch.setattr(lookups, "FEW_ANCHORS", few)
    items = spark.range(6000).select("id", F.element_at(F.array(*map(F.lit, ("red ring", "blue ring", "it"))), (F.col("id") % 3 + 1).cast("int")).alias("title"))
    anchors = spark.createDataFrame([("ring",), ("red ring",), ("i",), ("absent",)], "anchor string")
    found = lookups.contained_anchors(items, "title", anchors, "anchor")
    counts = {(r["title"], r["anchor"]): r["count"] for r in found.groupBy("title", "anchor").count().collect()}
    assert counts == {(t, a): 2000 for t, a in (("red ring", "ring"), ("red ring", "red ring"), ("red ring", "i"), ("blue ring", "ring"), ("blue ring", "i"), ("it", "i"))}
    found.collect()
    plan = _plan(found)
    assert "BuildLeft" not in plan
    assert ("hashpartitioning(_piece" in plan) == (few == 0)


def test_a_table_too_large_to_send_is_joined_by_key(spark):
    many = spark.range(1000).select(F.col("id").alias("key"))
    joined = spark.range(1000).select(F.col("id").alias("key")).join(session.small(many, 10), "key")
    assert len(joined.collect()) == 1000 and "SortMergeJoin" in _plan(joined) and "Broadcast" not in _plan(joined)


def test_exact_counts_of_a_period_from_daily_values(spark):
    visits = spark.range(60_000).select(
        F.lit("a").alias("source"), (F.col("id") % 40_000).alias("owner"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 50 * 86400).alias("ts"))
    odd = spark.createDataFrame([("a", None, None), ("a", 7, None), ("b", None, None)], "source string, owner long, ts timestamp")
    daily = sketches.daily_values(visits.unionByName(odd), ["source"], "ts", "owner")
    found = sketches.counted_in(daily, ["source"], "owner", F.date_trunc("month", "day").cast("date")).collect()
    want = visits.unionByName(odd).groupBy("source", F.date_trunc("month", "ts").cast("date").alias("period")).agg(
        F.countDistinct("owner").alias("distinct_values"), F.count("*").alias("n")).collect()
    assert sorted(map(str, found)) == sorted(map(str, want)) and len(found) == 4
    assert {(r["distinct_values"], r["n"]) for r in sketches.counted_in(daily, ["source"], "owner").collect()} == {(40_000, 60_002), (0, 1)}


def test_distinct_by_period_is_exact_for_many_owners(spark, tmp_path):
    events = spark.range(50_000).select(F.lit("view").alias("event_type"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 2_000_000).alias("ts"),
                                        (F.col("id") % 30_011).alias("user_id"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["distinct_by_period"](spark, str(tmp_path)).collect()
    assert [(r["event_type"], str(r["period"]), r["users"], r["n"]) for r in found] == [("view", "2024-01-01", 30_011, 50_000)]


@pytest.mark.parametrize("measure", ["cosine", "dot", "euclid"])
def test_best_by_runs_of_columns_are_the_best_of_all(monkeypatch, measure):
    rng = np.random.default_rng(3)
    refs = np.round(rng.normal(size=(1500, 4)), 1)
    refs[700:900] = refs[0]  # ties
    points = np.r_[np.round(rng.normal(size=(40, 4)), 1), np.zeros((1, 4))]
    if measure == "euclid":
        loss = ((points[:, None] - refs) ** 2).sum(axis=2)
    else:
        loss = -np.round(points @ refs.T, 9)
    bars = np.where(np.arange(len(points)) % 2, np.inf, np.sort(loss, axis=1)[:, 3])

    def refuse(*_, **__):
        raise AssertionError("every loss is sorted")

    whole = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *x, **y: refuse() if a.shape[1] == len(refs) else whole(a, *x, **y))
    for row, (places, losses) in enumerate(nearest._best(points, refs, 7, measure, bars)):
        order = [i for i in np.argsort(loss[row], kind="stable") if loss[row, i] <= bars[row] + 1e-12][:7]
        assert places.tolist()[: len(order)] == order and np.allclose(losses[: len(order)], loss[row, order])
    if measure != "euclid":
        assert not np.signbit(-next(nearest._best(np.zeros((1, 4)), refs, 1, measure, np.array([np.inf])))[1][0])


def test_words_are_encoded_some_rows_at_a_time(spark):
    made, most = vectors.hashed_words()(), nearest.ROWS

    def encoder():
        def run(texts):
            assert len(texts) <= most
            return made(texts)
        return run

    texts = spark.range(0, 3500, numPartitions=1).select("id", F.concat(F.lit("a b w"), F.col("id") % 7).alias("text"))
    encoded = vectors.encode(texts, "id", "text", lambda: encoder()).collect()
    assert {r["id"] for r in encoded} == set(range(3500)) and all(sum(r["embedding"]) == 3 for r in encoded)


def test_side_by_side_silhouettes_are_those_of_single_fits(spark):
    made = session.durable(spark.range(400).select(*[(F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(100)) / 100).alias(c) for i, c in enumerate(profiles.FEATURES)]))
    want = [(k, profiles.silhouette(profiles.behaviour_clusters(made, k))) for k in (4, 5, 6)]
    found = profiles.silhouettes(made, (4, 5, 6))
    assert [k for k, _ in found] == [4, 5, 6] and np.allclose([s for _, s in found], [s for _, s in want], rtol=0, atol=1e-9)


def test_noise_is_sought_among_the_most_frequent_texts_first(spark, monkeypatch):
    monkeypatch.setattr(terms, "LISTED", 2)
    rows = [("x", f"casino {i}") for i in range(40) for _ in range(3)] + [("x", "plain words")] * 2 + [("x", "other words"), (None, "plain words"), ("y", "a@b c"), ("x", "u")]
    found = terms.top_texts(spark.createDataFrame(rows, "lang string, text string"), ["lang"], "text", 2)
    assert sorted(((r["lang"], r["rank"], r["text"], r["n"]) for r in found.collect()), key=str) == sorted(
        [("x", 1, "plain words", 2), ("x", 2, "other words", 1), (None, 1, "plain words", 1)], key=str)


def test_texts_are_cut_into_words_once_for_their_clusters(spark, monkeypatch):
    docs = spark.range(40).select("id", F.concat(F.lit("word "), F.col("id") % 4).alias("text"))
    found = terms.content_clusters(docs, "id", "text", ["the"], 3, slots=64, iterations=3)
    assert found.count() == 40 and "split" not in found._jdf.queryExecution().optimizedPlan().toString()
