"""Music exports: play history (two sources), library, playlists, searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.functions import calendar as cal
from activity_engine.operators.select import first_per_key
from activity_engine.sources.records import json_rows

# The exports' field names.
_EXTENDED = (
    "ts string, master_metadata_track_name string, master_metadata_album_artist_name string, ms_played long, "
    "spotify_track_uri string, skipped boolean, shuffle boolean"
)
_ACCOUNT = "endTime string, artistName string, trackName string, msPlayed long"
_TRACK = "artist string, album string, track string, uri string"
_PLAYLIST = (
    "name string, lastModifiedDate string, items array<struct<addedDate:string,"
    "track:struct<trackName:string,artistName:string,albumName:string,trackUri:string>>>"
)
_SEARCHES = "searchQuery string, searchTime string, platform string"
MIN_PLAY_MS = 30_000


def _documents(spark: SparkSession, paths: str | Sequence[str], schema: str, level: int = 1, key: str | None = None) -> DataFrame:
    return json_rows(spark, paths, schema, level, key) if paths else spark.createDataFrame([], schema)


def play_history(spark: SparkSession, extended: str | Sequence[str], account: str | Sequence[str]) -> DataFrame:
    """Plays of both histories, or of the one there is (no paths: none). The same track in the same minute is one play, and the extended row is kept."""
    long = _documents(spark, extended, _EXTENDED).select(
        F.try_to_timestamp("ts", F.lit(cal.ISO_Z)).alias("listen_ts"),
        F.col("master_metadata_album_artist_name").alias("artistName"),
        F.col("master_metadata_track_name").alias("trackName"),
        F.col("ms_played").alias("msPlayed"), F.col("spotify_track_uri").alias("trackUri"), "skipped", "shuffle",
        F.lit(0).alias("priority"),
    )
    short = _documents(spark, account, _ACCOUNT).select(
        F.try_to_timestamp("endTime", F.lit(cal.MINUTE)).alias("listen_ts"), "artistName", "trackName", "msPlayed",
        F.lit(1).alias("priority"),
    )
    return merge_plays(long.unionByName(short, allowMissingColumns=True))


def merge_plays(plays: DataFrame) -> DataFrame:
    named = plays.filter(F.col("trackName").isNotNull() & F.col("listen_ts").isNotNull()).withColumn(
        "listen_minute", F.date_trunc("minute", "listen_ts")
    )
    unique = first_per_key(named, ["artistName", "trackName", "listen_minute"], ["priority", "listen_ts", "msPlayed"])
    long_enough = unique.filter(F.col("msPlayed") >= MIN_PLAY_MS).drop("priority")
    parts = cal.calendar_parts(F.col("listen_ts"))
    return long_enough.withColumns(
        {name.replace("event_", "listen_"): value for name, value in parts.items()}
        | {
            "minutes_played": F.round(F.col("msPlayed") / 60000.0, 2),
            "is_night": cal.is_night(F.hour("listen_ts")),
        }
    )


def library(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, _TRACK, 2, "tracks").select(
        F.col("artist").alias("artistName"), F.col("album").alias("albumName"),
        F.col("track").alias("trackName"), F.col("uri").alias("trackUri"),
    ).filter(F.col("trackName").isNotNull())


def playlists(spark: SparkSession, path: str) -> DataFrame:
    lists = _documents(spark, path, _PLAYLIST, 2, "playlists")
    items = lists.select(F.col("name").alias("playlistName"), "lastModifiedDate", F.explode("items").alias("i"))
    return items.select(
        "playlistName", "lastModifiedDate", "i.track.trackName", "i.track.artistName", "i.track.albumName",
        "i.track.trackUri", F.try_to_date("i.addedDate", "yyyy-MM-dd").alias("addedDate"),
    ).filter(F.col("trackName").isNotNull())


def searches(spark: SparkSession, path: str) -> DataFrame:
    read = _documents(spark, path, _SEARCHES).filter(F.length("searchQuery") > 0)
    found = read.select(
        cal.parse_search_time(F.col("searchTime")).alias("search_ts"), F.trim("searchQuery").alias("query"), "platform"
    ).filter(F.col("search_ts").isNotNull())
    return found.withColumns({"event_hour": F.hour("search_ts"), "event_weekday": F.dayofweek("search_ts")})
