"""Streams and sketches against the batch operators."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from activity_engine.operators import sketches
from activity_engine.operators.sessions import sessions as batch_sessions
from activity_engine.streaming import events

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "owner string, id int, ts timestamp"


def arrivals():
    """Events in batches of files: out of order by up to nine minutes, some repeated, with silences of exactly the gap."""
    rnd = random.Random(2)
    times, at = [], 0
    for _ in range(160):
        at += rnd.choice([5, 20, 60, 300, 301, 900])
        times.append(at)
    rows = [{"owner": rnd.choice(["a", "a", "b"]), "id": i, "ts": t} for i, t in enumerate(times)]
    late = sorted(rows, key=lambda r: r["ts"] + rnd.randint(0, 540))
    out = []
    for r in late:
        out.append(r)
        if rnd.random() < .2:
            out.append(r)
    return rows, [out[i: i + 40] for i in range(0, len(out), 40)] + [[{"owner": "z", "id": 9999, "ts": times[-1] + 90_000}]], times


def write(folder, number, rows):
    folder.mkdir(parents=True, exist_ok=True)
    lines = "\n".join(json.dumps({**r, "ts": (T0 + dt.timedelta(seconds=r["ts"])).strftime("%Y-%m-%dT%H:%M:%S.000Z")}) for r in rows)
    (folder / f"f{number}.json").write_text(lines)


def test_late_repeated_and_restarted_streams_give_the_batch_result(spark, tmp_path):
    rows, batches, times = arrivals()

    def run(name, made):
        """One query a batch, each started from the checkpoint of the one before."""
        for number, batch in enumerate(batches + [[{"owner": "z", "id": 10_000, "ts": times[-1] + 190_000}]]):
            write(tmp_path / f"in-{name}", number, batch)
            files = spark.readStream.schema(SCHEMA).json(str(tmp_path / f"in-{name}"))
            events.append(made(files), str(tmp_path / f"out-{name}"), str(tmp_path / f"ck-{name}")).awaitTermination()
        return spark.read.parquet(str(tmp_path / f"out-{name}"))

    once = run("once", lambda s: events.deduplicated(events.timely(s, "ts", "20 minutes"), ["id"]))
    got = sorted(r["id"] for r in once.collect())
    assert got == sorted([r["id"] for r in rows] + [9999, 10_000])

    both = run("both", lambda s: events.sessions(events.deduplicated(events.timely(s, "ts", "20 minutes"), ["id"]), "owner", "ts", 300))
    frame = spark.createDataFrame([(r["owner"], T0 + dt.timedelta(seconds=r["ts"])) for r in rows], "owner string, ts timestamp_ntz")
    expected = sorted((r["owner"], r["start_ts"], r["end_ts"], r["n_events"]) for r in batch_sessions(frame, "owner", "ts", 300).collect())
    ntz = both.where("owner <> 'z'").select("owner", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_ts", "end_ts")], "n_events")
    assert sorted(map(tuple, ntz.collect())) == expected and len(expected) > 20


def test_an_event_later_than_allowed_is_dropped(spark, tmp_path):
    for number, seconds in enumerate([0, 10_000, 100, 20_000]):
        write(tmp_path / "in", number, [{"owner": "a", "id": number, "ts": seconds}])
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        events.append(events.deduplicated(events.timely(stream, "ts", "10 minutes"), ["id"]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 3]


@pytest.fixture(scope="module")
def visits(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < .5 else rnd.choice("abc"), T0 + dt.timedelta(hours=rnd.randint(0, 24 * 60)), rnd.randint(0, 30_000)) for _ in range(40_000)]
    return spark.createDataFrame(rows + [("a", None, 1), ("a", T0, None)], "source string, ts timestamp_ntz, item int").repartition(5).cache()


def test_periods_are_within_the_bound(spark, visits):
    daily = sketches.daily_sketches(visits, ["source"], "ts", "item").cache()
    for period, exact in ((F.date_trunc("month", "day").cast("date"), F.date_trunc("month", "ts").cast("date")), (None, None)):
        found = sketches.distinct_in(daily, ["source"], period).collect()
        known = visits.where("ts is not null and item is not null")
        counted = known.groupBy("source", *([exact.alias("period")] if exact is not None else [])).agg(F.countDistinct("item").alias("d"), F.count("*").alias("n"))
        truth = {(r["source"], r["period"] if exact is not None else None): (r["d"], r["n"]) for r in counted.collect()}
        assert len(found) == len(truth)
        inside = 0
        for r in found:
            d, n = truth[r["source"], r["period"] if period is not None else None]
            assert abs(r["distinct_values"] - d) <= 4 * sketches.standard_error() * d + 1 and r["n"] == n
            inside += r["at_least"] <= d <= r["at_most"]
        assert inside >= .75 * len(found)


def test_united_days_equal_the_sketch_of_the_whole(spark, visits):
    daily = sketches.daily_sketches(visits, ["source"], "ts", "item")
    whole = visits.where("ts is not null").groupBy("source").agg(F.hll_sketch_estimate(F.hll_sketch_agg("item", F.lit(sketches.BUCKETS_LOG2))).alias("d"))
    assert {r["source"]: r["distinct_values"] for r in sketches.distinct_in(daily, ["source"]).collect()} == {r["source"]: r["d"] for r in whole.collect()}


def test_a_stored_table_grows_by_fresh_days(spark, visits):
    early, late = visits.where("day(ts) <= 20 or item is null"), visits.where("day(ts) >= 15")
    both = sketches.merged(*[sketches.daily_sketches(part, ["source"], "ts", "item") for part in (early, late)], ["source"])
    whole = sketches.daily_sketches(visits, ["source"], "ts", "item")
    told = lambda df: {(r["source"], r["day"]): r["d"] for r in df.withColumn("d", F.hll_sketch_estimate("sketch")).collect()}
    assert told(both) == told(whole)
