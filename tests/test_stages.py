"""Whole jobs on small exports."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from activity_engine import stages
from activity_engine.operators import corpus
from activity_engine.sources import social
from activity_engine.warehouse import Warehouse
from tests.test_sources import cell, write


@pytest.fixture
def house(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "house"))


def test_ingest_twice_then_profile(spark, house, tmp_path):
    inbox = tmp_path / "in"
    write(inbox / "NetflixViewingHistory.csv", "Title,Date\n" + "\n".join(f'"Show {i}: Saison 1: E",1/{i + 1}/24' for i in range(20)))
    write(inbox / "account/SearchQueries.json", [{"searchQuery": "jazz", "searchTime": "2024-01-05T10:11:12.123Z[UTC]", "platform": "X"}])
    write(inbox / "extended/Streaming_History_Audio_0.json", [
        {"ts": f"2024-01-{d:02d}T08:00:00Z", "master_metadata_track_name": "t", "master_metadata_album_artist_name": "Miles Davis", "ms_played": 40000}
        for d in range(1, 15)])
    write(inbox / "account/StreamingHistory_music_0.json", [])
    page = write(tmp_path / "s.html", "".join(
        cell(f'<a href="https://www.google.com/search?q=red+guitar+{i}">red guitar</a><br>{i + 1} janv. 2024, 15:00:00') for i in range(12)))
    clips = write(tmp_path / "c.json", {"Your Activity": {"Watch History": {"VideoList": [
        {"Link": f"https://t/video/{i}", "Date": f"2024-01-{i + 1:02d} 23:30:00"} for i in range(15)]}}})

    def run():
        return (stages.ingest_films(house, str(inbox)) | stages.ingest_music(house, str(inbox))
                | stages.ingest_activity_pages(house, searches=page) | stages.ingest_clips(house, clips, "me", "s"))

    first, again = run(), run()
    assert (first["netflix_views"], first["spotify_streams"], first["google_searches"], first["tiktok_watch"]) == (20, 14, 12, 15)
    assert first["spotify_searches"] == 1 and not any(again.values())

    assert stages.profile_behaviour(house, k=2) == {"behavioral_clusters": 2}
    clusters = house.read("behavioral_clusters").collect()
    assert sorted(p for c in clusters for p in c["top_platforms"]) == ["google", "netflix", "spotify", "tiktok"]
    assert sum(c["item_count"] for c in clusters) == 61
    assert stages.profile_interests(house) == {"interest_profiles": 2}
    words = {w for r in house.read("interest_profiles").collect() for w in r["keywords"] or []}
    assert {"red guitar", "miles davis", "guitar"} <= words
    checks = {(r["table_name"], r["check"]): r["passed"] for r in stages.check_warehouse(house).collect()}
    assert checks["tiktok_watch", "time"] and not checks["spotify_streams", "time"]  # fifteen days where one is wanted, fourteen where a year is
    assert checks["netflix_views", "watch_date not_null"] and not checks["netflix_views", "required"] and checks["spotify_streams", "unique"]


def test_profiles_read_whole_tables_and_single_histories(spark, house, tmp_path):
    inbox = tmp_path / "in"
    write(inbox / "account/StreamingHistory_music_0.json", [
        {"endTime": "2024-01-05 08:00", "artistName": "a", "trackName": f"t{i}", "msPlayed": 40000} for i in range(3)])
    assert stages.ingest_music(house, str(inbox))["spotify_streams"] == 3
    clips = write(tmp_path / "c.json", {"Your Activity": {"Watch History": {"VideoList": [
        {"Link": f"https://t/video/{i}", "Date": f"2024-01-{i % 28 + 1:02d} 23:{i // 28 % 60:02d}:30"} for i in range(2300)]}}})
    watched = stages.ingest_clips(house, clips, "me", "s")["tiktok_watch"]
    assert watched > 2000
    counts = {r["platform"]: r["count"] for r in stages.unified_events(house).groupBy("platform").count().collect()}
    assert counts == {"spotify": 3, "tiktok": watched}


def test_equal_rows_of_two_owners_are_two_rows(spark, house, tmp_path):
    inbox = tmp_path / "in"
    write(inbox / "NetflixViewingHistory.csv", 'Title,Date\n"Film",1/3/24\n"Show: Saison 1: E",1/4/24\n')
    write(inbox / "account/YourLibrary.json", {"tracks": [{"artist": "A", "album": "B", "track": "T", "uri": "u"}]})
    for owner in ("ann", "bob", "ann"):
        stages.ingest_films(house, str(inbox), owner)
        stages.ingest_music(house, str(inbox), owner)
    assert {r["owner"]: r["count"] for r in house.read("netflix_views").groupBy("owner").count().collect()} == {"ann": 2, "bob": 2}
    assert house.read("spotify_liked_songs").count() == 2
    assert stages.unified_events(house).count() == 4 and stages.unified_events(house, "bob").count() == 2
    checks = {(r["table_name"], r["check"]): r["passed"] for r in stages.check_warehouse(house).collect()}
    assert checks["netflix_views", "unique"] and checks["spotify_liked_songs", "unique"]


def test_two_albums_with_equal_photo_ids(spark, house):
    def at(day):
        return dt.datetime(2024, 1, day, 12)

    photos = spark.createDataFrame(
        [(album, f"{i}", f"/{album}/{i}.jpg", f"{i}.jpg", at(1 + i // 3), [1.0, i / 10]) for album in ("a", "b") for i in range(6)],
        "album string, photo_id string, path string, filename string, exif_date timestamp_ntz, embedding array<double>")
    assert stages.build_album(house, photos) == {"scenes": 12, "scene_centroids": 4}
    assert all(r["photo_count"] == 3 for r in house.read("scene_centroids").collect())
    checks = {(r["table_name"], r["check"]): r["passed"] for r in stages.check_warehouse(house).collect()}
    assert checks["scene_centroids", "unique"]


def test_messages_to_corpus_and_contacts(spark, house, tmp_path):
    def thread(folder, people, n):
        write(tmp_path / f"ig/messages/inbox/{folder}/message_1.json", {
            "participants": [{"name": p} for p in people],
            "messages": [{"sender_name": people[i % len(people)], "timestamp_ms": 1704412800000 + i, "content": "mouais du coup dcp " + "mot " * 31}
                         for i in range(n)]})

    thread("bob_1234567890", ["Me", "Bob"], 8)
    thread("ann_1234567890", ["Me", "Ann"], 3)
    thread("trio_1234567890", ["Me", "Bob", "Ann"], 9)
    assert stages.ingest_social(house, str(tmp_path / "ig"), "s")["instagram_messages_meta"] == 20
    messages = social.messages(spark, str(tmp_path / "ig/messages/inbox/*/message_*.json"))
    close = spark.createDataFrame([("Bob",)], "contact string")
    assert stages.build_contacts(house, messages, close) == {"social_graph": 1}
    row = house.read("social_graph").first()
    assert (row["node_id"], row["label"], row["message_count"], row["is_close"], row["weight"]) == ("bob_1234567890", "bob", 8, True, 16.0)

    written = stages.build_corpus(house, social.conversation_text(messages), "Me", sizes=(2, 5))
    assert written["examples"] > 0
    stages.export_corpus(house, "Me", "Other", corpus.Style(), 3)
    lines = [json.loads(r[0]) for r in spark.read.text(f"{house.root}/corpus_json").collect()]
    assert len(lines) == 3 and lines[0]["messages"][-1]["role"] == "assistant"
    text = "\n".join(r[0] for r in spark.read.text(f"{house.root}/corpus_text").collect())
    assert "--- Exemple 3 ---" in text and "Other: mouais" in text


def test_album(spark, house):
    def at(day):
        return dt.datetime(2024, 1, day, 12)

    photos = spark.createDataFrame(
        [("a", f"p{i}", f"/x/p{i}.jpg", f"p{i}.jpg", at(1 + i // 4), [1.0, i / 10, 0.5, -i / 7]) for i in range(12)]
        + [("a", "u", "/x/u.jpg", "u.jpg", None, [])],
        "album string, photo_id string, path string, filename string, exif_date timestamp_ntz, embedding array<double>")
    assert stages.build_album(house, photos) == {"scenes": 13, "scene_centroids": 3}
    assert stages.build_album(house, photos) == {"scenes": 13, "scene_centroids": 3}
    scene = house.read("scene_centroids").filter("scene_id = 0").first()
    assert scene["photo_count"] == 4 and len(scene["centroid_embedding"]) == 4 and scene["timestamp_start"] == at(1)
    assert house.read("scenes").filter(F.col("photo_id") == "u").first()["scene_name"] == "Moment sans date"
    assert stages.cluster_photos(house, photos, 2, 3, {0: "all"}) == {"photo_clusters": 12}
    # a merged scene is gone for good, and another album stays
    later = photos.withColumn("exif_date", F.when(F.col("exif_date").isNotNull(), F.lit(at(1)))).withColumn("album", F.lit("a"))
    other = photos.withColumn("album", F.lit("b"))
    assert stages.build_album(house, other) == {"scenes": 26, "scene_centroids": 6}
    assert stages.build_album(house, later) == {"scenes": 26, "scene_centroids": 4}
    music = [("b", at(1) + dt.timedelta(minutes=5 * i), f"t{i % 2}", i) for i in range(7)] + [("a", dt.datetime(2020, 1, 1), "old", 99)]
    plays = spark.createDataFrame(music, "album string, ts timestamp_ntz, track string, play_id int")
    none = spark.createDataFrame([], "album string, photo_id string, track string, match_score double")
    dear = spark.createDataFrame([("b", "p5", "dear", 0.8)], none.schema)
    made = stages.match_album(house, plays, none.drop("match_score"), dear, none)
    assert made == {"photo_music": 26, "music_matches": 4, "group_playlists": 7}
    found = {(r["album"], r["scene_id"]): (r["track"], r["match_type"]) for r in house.read("music_matches").collect()}
    assert found == {("a", 0): ("old", "fallback"), ("b", 0): ("t0", "temporal"), ("b", 1): ("dear", "semantic"), ("b", 2): ("t0", "fallback")}
    assert stages.match_album(house, plays, none.drop("match_score"), dear, none) == made
    section = spark.createDataFrame([("s", "m", "", 1.0)], "section string, metric string, key string, value double")
    assert stages.build_report(house, {"one": lambda: section, "two": lambda: section}, ["two"]) == {"report": 1}
    checks = {(r["table_name"], r["check"]): r["passed"] for r in stages.check_warehouse(house).collect()}
    assert all(checks[t, c] for t, c in [("music_matches", "orphans scene_id"), ("group_playlists", "orphans scene_id"), ("music_matches", "unique"), ("music_matches", "match_type one_of"),
                                          ("photo_music", "required"), ("group_playlists", "unique")])
