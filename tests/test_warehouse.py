"""Tables: merges that can be repeated, snapshots, exports, streams, quality rules."""

import pytest
from pyspark.sql import functions as F

from activity_engine import schemas
from activity_engine.operators import merge, quality
from activity_engine.streaming.ingest import ingest
from activity_engine.warehouse import PLAY_ROLES, Warehouse, resolve_columns, with_bucket

SCHEMA = "k string, t int, v int"


@pytest.fixture
def house(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "house"))


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_insert_absent_is_idempotent(spark, house):
    first = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), (None, 1, 3), (None, 1, 4)], SCHEMA)
    assert house.insert_absent("t", first, ["k", "t"]) == 2
    assert house.insert_absent("t", first, ["k", "t"]) == 0
    more = spark.createDataFrame([("a", 1, 9), ("b", 1, 5), ("b", 1, 6)], SCHEMA)
    assert house.insert_absent("t", more, ["k", "t"]) == 1
    assert content(house.read("t")) == [("a", 1, 1), ("b", 1, 5), (None, 1, 3)]


def test_insert_by_month_reads_only_its_months(spark, house):
    schema = "id int, event_month string"
    assert house.insert_absent("t", spark.createDataFrame([], schema), ["id"], ["id"], "event_month") == 0
    assert house.read("t") is None and not house.exists("t")
    rows = [(1, "2024-01"), (2, "2024-02"), (3, None)]
    assert house.insert_absent("t", spark.createDataFrame(rows, schema), ["id", "event_month"], ["id"], "event_month") == 3
    more = spark.createDataFrame([*rows, (4, "2024-02"), (5, None)], schema)
    assert house.insert_absent("t", more, ["id", "event_month"], ["id"], "event_month") == 2
    read = house.read("t")
    assert dict(read.dtypes)["event_month"] == "string" and read.filter("event_month = '2024-02'").count() == 2
    plan = read.filter("event_month = '2024-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan


def test_upsert_and_overwrite(spark, house):
    house.upsert("t", spark.createDataFrame([("a", 1, 1), ("b", 1, 1), (None, 1, 7)], SCHEMA), ["k"])
    assert house.upsert("t", spark.createDataFrame([("b", 2, 2), ("c", 1, 1), (None, 2, 8)], SCHEMA), ["k"]) == 4
    assert content(house.read("t")) == [("a", 1, 1), ("b", 2, 2), ("c", 1, 1), (None, 2, 8)]
    before = house.read("t")
    assert house.overwrite("t", spark.createDataFrame([("z", 1, 1)], SCHEMA)) == 1
    assert content(house.read("t")) == [("z", 1, 1)]
    assert before.count() == 4  # a reader keeps its snapshot


def files(tmp_path, name):
    return {str(f.relative_to(tmp_path)): f.stat().st_mtime_ns for f in (tmp_path / f"house/{name}").rglob("part-*")}


def test_a_one_row_batch_rewrites_one_bucket(spark, house, tmp_path):
    rows = [(f"k{i}", i, i) for i in range(300)]
    assert house.upsert("t", spark.createDataFrame(rows, SCHEMA), ["k"]) == 300
    before = files(tmp_path, "t")
    assert len({f.split("/")[-2] for f in before}) == 16 and len(before) == 16
    assert house.upsert("t", spark.createDataFrame([("k7", 1, -1)], SCHEMA), ["k"]) == 300
    after = files(tmp_path, "t")
    assert len(set(before) - set(after)) == 1 == len(set(after) - set(before)) and all(before[f] == after[f] for f in set(before) & set(after))
    assert content(house.read("t")) == sorted([r for r in rows if r[0] != "k7"] + [("k7", 1, -1)], key=str)

    assert house.insert_absent("i", spark.createDataFrame(rows, SCHEMA), ["k", "t"]) == 300
    before = files(tmp_path, "i")
    assert house.insert_absent("i", spark.createDataFrame([("new", 1, 1), rows[3]], SCHEMA), ["k", "t"]) == 1
    after = files(tmp_path, "i")
    assert set(before) < set(after) and len(after) == len(before) + 1
    more = with_bucket(spark.createDataFrame([("new", 1, 1)], SCHEMA), ["k", "t"], 16)
    plan = house._beside(house._stored("i"), more, "_bucket_16")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket_16" in plan


def test_a_lost_merge_changes_nothing_and_can_be_run_again(spark, house, tmp_path):
    rows = [(f"k{i}", i, i) for i in range(60)]
    house.upsert("t", spark.createDataFrame(rows, SCHEMA), ["k"])
    before = files(tmp_path, "t")
    bad = spark.createDataFrame([(f"k{i}", 0, 0) for i in range(60)], SCHEMA)
    broken = bad.withColumn("v", F.when(F.col("k") == "k59", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        house.upsert("t", broken, ["k"])
    with pytest.raises(Exception, match="lost"):  # while files are being written
        house._write(broken.withColumn("_bucket_16", F.lit(3)), house._versions("t")[-1], "overwrite", "_bucket_16")
    assert files(tmp_path, "t") == before and content(house.read("t")) == sorted(rows, key=str)
    assert house.upsert("t", bad, ["k"]) == 60 and house.read("t").agg(F.sum("v")).first()[0] == 0


def test_groups_are_replaced_as_a_whole(spark, house):
    schema = "album string, scene int, n int"
    first = spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("b", 0, 1), (None, 0, 1)], schema)
    assert house.replace_groups("s", first, ["album"]) == 4
    assert house.replace_groups("s", spark.createDataFrame([("a", 0, 2), (None, 5, 2)], schema), ["album"]) == 3
    assert content(house.read("s")) == [("a", 0, 2), ("b", 0, 1), (None, 5, 2)]
    house.overwrite("s", spark.createDataFrame([("z", 0, 1), ("b", 1, 1)], schema))  # no buckets any more
    assert house.replace_groups("s", spark.createDataFrame([("b", 7, 7)], schema), ["album"]) == 2
    assert house.insert_absent("s", spark.createDataFrame([("b", 7, 9), ("q", 0, 0)], schema), ["album"]) == 1
    assert house.read("s").columns == ["album", "scene", "n"] and house.read("s").count() == 3


def test_unfinished_version_is_not_read(spark, house, tmp_path):
    house.overwrite("t", spark.createDataFrame([("a", 1, 1)], SCHEMA))
    (tmp_path / "house/t/v000002").mkdir()
    assert house.read("t").count() == 1


def test_writing_goes_on_after_a_lost_job(spark, house, tmp_path):
    batch = spark.createDataFrame([("a", 1, 1)], SCHEMA)
    for name, write in (("o", lambda: house.overwrite("o", batch)), ("u", lambda: house.upsert("u", batch, ["k"])),
                        ("i", lambda: house.insert_absent("i", batch, ["k", "t"]))):
        (tmp_path / f"house/{name}/v000001").mkdir(parents=True)
        (tmp_path / f"house/{name}/v000001/part-0").write_text("left over")
        assert write() == 1 and house.read(name).count() == 1
    house.overwrite("o", batch)
    (tmp_path / "house/o/v000009").mkdir()
    assert house.upsert("o", spark.createDataFrame([("b", 1, 1)], SCHEMA), ["k"]) == 2


def test_read_tolerates_missing_tables_and_columns(spark, house):
    assert house.read("none") is None and not house.exists("none")
    house.overwrite("t", spark.createDataFrame([("a", 1, 1)], SCHEMA))
    assert house.read("t", ["v", "other"]).columns == ["v"]


def test_exports(spark, house, tmp_path):
    df = spark.createDataFrame([("a", 1, 1)], SCHEMA)
    house.export_json(df, "json")
    house.export_csv(df, "csv")
    house.export_text(df.select("k"), "text")
    assert spark.read.json(f"{house.root}/json").count() == 1
    assert spark.read.option("header", True).csv(f"{house.root}/csv").columns == ["k", "t", "v"]
    assert [r[0] for r in spark.read.text(f"{house.root}/text").collect()] == ["a"]


def test_stream_merges_each_file_once(spark, house, tmp_path):
    inbox = tmp_path / "inbox"
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], SCHEMA).coalesce(1).write.json(str(inbox))

    def run():
        files = spark.readStream.schema(SCHEMA).json(str(inbox))
        ingest(files, house, "t", ["k", "t"], str(tmp_path / "ck")).awaitTermination()
        return house.read("t").count()

    assert run() == 2
    spark.createDataFrame([("b", 1, 9), ("c", 1, 1)], SCHEMA).coalesce(1).write.mode("append").json(str(inbox))
    assert run() == 3 and run() == 3


def test_merge_of_frames_is_null_safe(spark):
    target = spark.createDataFrame([(None, 1, 1)], SCHEMA)
    batch = spark.createDataFrame([(None, 1, 2), (None, 1, 3), ("a", 1, 1)], SCHEMA)
    assert content(merge.insert_absent(target, batch, ["k", "t"], ["v"])) == [("a", 1, 1), (None, 1, 1)]
    assert content(merge.upsert(target, batch, ["k", "t"], ["v"])) == [("a", 1, 1), (None, 1, 2)]


def test_column_roles():
    assert resolve_columns(["listen_ts", "trackUri", "trackName", "artistName"], PLAY_ROLES)["timestamp"] == "listen_ts"
    assert resolve_columns(["listen_ts"], PLAY_ROLES) is None


def test_table_rules(spark):
    tables = schemas.tables()
    plays = spark.createDataFrame(
        [("t", "a", "2024-01-01", 30000), ("t", "a", "2024-01-01", 29999), (None, "a", None, 40000)],
        "trackName string, artistName string, listen_ts string, msPlayed long").withColumn("listen_ts", F.to_timestamp("listen_ts"))
    rules = tables["spotify_streams"]
    got = {(r["column"], r["rule"]): (r["violations"], r["passed"]) for r in quality.check_rules(plays, "p", rules.rules).collect()}
    assert got == {("trackName", "not_null"): (1, False), ("artistName", "not_null"): (0, True),
                   ("listen_ts", "not_null"): (1, False), ("msPlayed", "at_least"): (1, False)}
    dups = quality.check_unique(plays, "p", rules.unique).first()
    assert (dups["duplicates"], dups["passed"]) == (1, False)
    assert quality.check_unique(plays, "p", ["artistName"], 2).first()["passed"]
    missing = quality.check_required(plays, "p", ["trackName", "other"], 1).first()
    assert (missing["status"], missing["detail"]) == ("FAIL", "missing: other")
    assert all(set(t.unique) <= set(t.columns) for t in tables.values())
