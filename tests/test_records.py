"""Records of JSON documents cut into many splits, against one parse of the whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from activity_engine.sources import music, posts, records
from tests.test_sources import write


def odd_text(rnd):
    return "".join(rnd.choice(['"', "\\", "{", "}", "[", "]", "\n", "é", "日", "a", " ", ":", ",", '"}', "{\"", "\\\""]) for _ in range(rnd.randint(0, 12)))


def elements(n, seed):
    rnd = random.Random(seed)

    def value(depth):
        kind = rnd.randint(0, 5 if depth < 3 else 2)
        if kind <= 2:
            return (odd_text(rnd), rnd.randint(-5, 5), None)[kind]
        if kind == 3:
            return [value(depth + 1) for _ in range(rnd.randint(0, 3))]
        return {odd_text(rnd) + str(i): value(depth + 1) for i in range(rnd.randint(0, 3))}

    return [{"id": i, odd_text(rnd): value(0), "t": odd_text(rnd)} for i in range(n)]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def told(df):
    return [json.loads(r["record"]) for r in df.orderBy("path", "number").collect()]


@pytest.mark.parametrize("indent", [None, 1])
def test_outermost_array(small_splits, tmp_path, indent):
    made = elements(150, 1) + [{"id": 150, "long": "x}{" * 2000}] + elements(20, 2)
    path = write(tmp_path / "a.json", json.dumps(made, ensure_ascii=False, indent=indent))
    found = records.json_records(small_splits, path)
    assert told(found) == made
    splits = small_splits.read.option("lineSep", "}").text(path).rdd.getNumPartitions()
    assert splits > 10


def test_arrays_by_key(small_splits, tmp_path):
    made = {"tracks": elements(60, 3), "other": {"deep": [{"no": 1}]}, "albums": elements(50, 4), "none": [], "last": [{"id": 9}]}
    path = write(tmp_path / "b.json", made)
    for key in ("tracks", "albums", "last", "none"):
        assert told(records.json_records(small_splits, path, 2, key)) == made[key]
    assert len(told(records.json_records(small_splits, path, 2))) >= 111


def test_several_files_and_odd_ones(small_splits, tmp_path):
    write(tmp_path / "in/a.js", "window.YTD.tweets.part0 = " + json.dumps(elements(40, 5)))
    write(tmp_path / "in/b.js", "window.YTD.tweets.part1 = [ ]")
    write(tmp_path / "in/c.js", "")
    write(tmp_path / "in/d.js", '[{"id": 1}, "text", 5, [{"id": 2}], {"id": 3, "cut": "off')
    found = records.json_records(small_splits, str(tmp_path / "in")).collect()
    whole = [json.loads(r["record"]) for r in found if r["path"].endswith("a.js")]
    assert sorted(r["id"] for r in whole) == list(range(40))
    assert sorted(r["record"][:9] for r in found if r["path"].endswith("d.js")) == ['{"id": 1}', '{"id": 3,']
    rows = records.json_rows(small_splits, str(tmp_path / "in"), "id int, t string").where("id is not null")
    assert rows.count() >= 41


def test_readers_agree_with_one_task(small_splits, tmp_path):
    plays = [{"ts": f"2024-01-{1 + i % 28:02d}T{i % 24:02d}:10:12Z", "master_metadata_track_name": f"t{i} }}{{", "master_metadata_album_artist_name": 'A"[',
              "ms_played": 30000 + i, "spotify_track_uri": f"u{i}", "skipped": None, "shuffle": True} for i in range(300)]
    path = write(tmp_path / "e.json", plays)
    whole = small_splits.read.schema(music._EXTENDED).option("multiLine", True).json(path)
    assert sorted(map(str, records.json_rows(small_splits, path, music._EXTENDED).collect())) == sorted(map(str, whole.collect()))
    assert music.play_history(small_splits, path, []).count() == 300
    library = write(tmp_path / "l.json", {"tracks": [{"artist": "A", "album": "}", "track": f"T{i}", "uri": f"u{i}"} for i in range(200)], "shows": [{"track": "no"}]})
    assert music.library(small_splits, library).count() == 200
    posted = write(tmp_path / "t.js", "window.YTD.tweets.part0 = " + json.dumps([{"tweet": {"id_str": str(i), "full_text": f"@x hi }} {i}"}} for i in range(120)]))
    assert posts.tweets(small_splits, posted).select(F.countDistinct("tweet_id")).first()[0] == 120
