"""Sessions and time joins against brute force; edge cases of windows and gaps."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from activity_engine.operators import stabbing, timejoins
from activity_engine.operators.sessions import sessions, with_session

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def frame(spark, rows, schema="owner string, id int, ts timestamp_ntz"):
    return spark.createDataFrame([(o, i, at(s)) for o, i, s in rows], schema)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 400)), min_size=1, max_size=40))
def test_sessions_split_exactly_where_the_gap_is_longer(spark, events):
    df = frame(spark, [(o, i, s) for i, (o, s) in enumerate(events)])
    got = sorted((r["owner"], r["session_no"], r["start_ts"], r["end_ts"], r["n_events"]) for r in sessions(df, "owner", "ts", 30).collect())
    expected = []
    for owner in "ab":
        times = sorted(s for o, s in events if o == owner)
        runs = []
        for s in times:
            if runs and s - runs[-1][-1] <= 30:
                runs[-1].append(s)
            else:
                runs.append([s])
        expected += [(owner, n, at(r[0]), at(r[-1]), len(r)) for n, r in enumerate(runs)]
    assert got == sorted(expected)


def test_a_gap_of_exactly_the_threshold_stays_in_the_session(spark):
    df = frame(spark, [("a", 1, 0), ("a", 2, 30), ("a", 3, 61), ("b", 4, 10)])
    got = {r["id"]: r["session_no"] for r in with_session(df, "owner", "ts", 30).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(3)
    owners = ["hot"] * 150 + [rng.choice("abcdef") for _ in range(300)]
    probes = [(o, i, rng.randint(0, 2000)) for i, o in enumerate(owners[:200])]
    events = [(o, 1000 + i, rng.randint(0, 2000), rng.randint(0, 4)) for i, o in enumerate(owners)]
    events_df = spark.createDataFrame([(o, i, at(s), k) for o, i, s, k in events], "owner string, id int, ts timestamp_ntz, item int")
    return probes, events, frame(spark, probes), events_df


def test_window_counts(spark, crowd):
    probes, events, probes_df, events_df = crowd
    got = {r["id"]: r["n"] for r in timejoins.window_counts(probes_df, events_df, ["owner"], ["id"], "ts", 50).collect()}
    assert got == {i: sum(o == p and abs(s - t) <= 50 for p, _, t, _ in events) for o, i, s in probes}


@pytest.mark.parametrize("seconds, chunk_marks", [(7, 100_000), (50, 40), (400, 15)])
def test_modal_item_nearby(spark, crowd, seconds, chunk_marks):
    probes, events, probes_df, events_df = crowd
    found = timejoins.modal_item_nearby(probes_df, events_df, "owner", "id", "ts", "item", seconds, chunk_marks)
    got = {r["id"]: (r["item"], r["n"]) for r in found.collect()}
    expected = {}
    for o, i, s in probes:
        counts = {}
        for p, _, t, k in events:
            if p == o and abs(s - t) <= seconds:
                counts[k] = counts.get(k, 0) + 1
        if counts:
            expected[i] = min(counts.items(), key=lambda c: (-c[1], c[0]))
    assert got == expected


def test_rare_items_make_no_pairs(spark):
    """Every item once, all near all probes: there are two spans for an event at most, and a few tree nodes for a span."""
    n = 400
    events = spark.createDataFrame([("a", at(i), f"t{i * 7 % n:04d}") for i in range(n)], "owner string, ts timestamp_ntz, item string")
    probes = frame(spark, [("a", i, i) for i in range(n)])
    spans = timejoins.item_spans(events, "owner", "ts", "item", 60)
    assert spans.count() <= 2 * n
    placed = stabbing._located(spans.withColumn("owner", F.lit("a")), {"start": "first", "end": "last"}, [("a", i * 10_000_000 + 1_704_067_200_000_000) for i in range(40)])
    covers = placed.where("first + 1 < last").select(F.size(stabbing._cover(F.col("first") + 1, F.col("last") - 1)).alias("n"))
    assert covers.agg(F.max("n")).first()[0] <= 6 and 5 * covers.count() > n
    got = {r["id"]: (r["item"], r["n"]) for r in timejoins.modal_item_nearby(probes, events, "owner", "id", "ts", "item", 60, 50).collect()}
    assert got == {i: (min(f"t{j * 7 % n:04d}" for j in range(max(0, i - 60), min(n, i + 61))), 1) for i in range(n)}


def test_covers_are_exact(spark):
    pairs = spark.createDataFrame([(a, b) for a in range(0, 40) for b in range(a - 1, 40)], "a long, b long")
    for r in pairs.select("a", "b", stabbing._cover(F.col("a"), F.col("b")).alias("c")).collect():
        inside = [x for n in r.c for x in range(n.place << n.level, (n.place + 1) << n.level)]
        assert sorted(inside) == list(range(r.a, r.b + 1)) and len(r.c) <= 10


def test_best_span_ignores_what_has_no_owner_or_item(spark):
    probes = spark.createDataFrame([("a", 1, 5), (None, 2, 5), ("a", 3, None), ("b", 4, 5), ("a", 5, 11)], "o string, id int, at long")
    spans = spark.createDataFrame([("a", 0, 10, 1, "x"), ("a", 5, 5, 1, "w"), (None, 0, 10, 9, "y"), ("a", 0, 10, 9, None), ("a", 9, 3, 9, "z")],
                                  "o string, s long, e long, n long, item string")
    found = stabbing.best_spans(probes, spans, "o", "id", F.col("at"), F.col("s"), F.col("e"), F.col("n"), F.col("item"), 2)
    assert [tuple(r) for r in found.collect()] == [(1, "w", 1)]
    assert stabbing.best_spans(probes.where("false"), spans.where("false"), "o", "id", F.col("at"), F.col("s"), F.col("e"), F.col("n"), F.col("item")).count() == 0


def test_nearest_in_time(spark, crowd):
    probes, events, probes_df, events_df = crowd
    marks = events_df.filter("item = 0").select("owner", F.col("id").alias("mark"), "ts")
    found = timejoins.nearest_in_time(probes_df, marks, ["owner"], "id", "mark", "ts")
    got = {r["id"]: r["mark"] for r in found.collect()}
    expected = {}
    for o, i, s in probes:
        near = [(abs(s - t), e) for p, e, t, k in events if p == o and k == 0]
        expected[i] = min(near)[1] if near else None
    assert got == expected


def test_nearest_in_time_ties_and_ends(spark):
    marks = frame(spark, [("a", 5, 10), ("a", 3, 20)]).withColumnRenamed("id", "mark")
    probes = frame(spark, [("a", 1, 0), ("a", 2, 15), ("a", 3, 99), ("z", 4, 5)])
    got = {r["id"]: r["mark"] for r in timejoins.nearest_in_time(probes, marks, ["owner"], "id", "mark", "ts").collect()}
    assert got == {1: 5, 2: 3, 3: 3, 4: None}


def test_span_join_includes_both_edges_once(spark):
    spans = spark.createDataFrame([("a", 1, at(100), at(200))], "owner string, span int, s timestamp_ntz, e timestamp_ntz")
    events = frame(spark, [("a", i, s) for i, s in enumerate([89, 90, 150, 210, 211])] + [("b", 9, 150)])
    got = sorted(r["id"] for r in timejoins.span_join(spans, events, "owner", "s", "e", "ts", 10).collect())
    assert got == [1, 2, 3]


def test_cascade_takes_the_first_level(spark):
    probes = spark.createDataFrame([(i,) for i in range(4)], "id int")
    one = spark.createDataFrame([(0, "x")], "id int, track string")
    two = spark.createDataFrame([(0, "y"), (1, "z")], "id int, track string")
    got = {r["id"]: (r["track"], r["match_type"]) for r in timejoins.cascade(probes, "id", [("manual", one), ("near", two)], ["track"]).collect()}
    assert got == {0: ("x", "manual"), 1: ("z", "near"), 2: (None, "none"), 3: (None, "none")}
