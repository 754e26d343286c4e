"""Music library and the tag replies applied to it, and example files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.functions.nested import reply_tags

_LIBRARY = "track_id string, track_name string, artist string, album_cover_url string, moments array<string>"
_EXAMPLES = "messages array<struct<role:string,content:string>>, score double"


def music_library(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_LIBRARY).option("multiLine", True).json(path)


def examples(spark: SparkSession, path: str) -> DataFrame:
    """Training examples, one JSON object per line; blank and broken lines are skipped."""
    return spark.read.schema(_EXAMPLES).option("mode", "DROPMALFORMED").json(path).filter(F.col("messages").isNotNull())


def replies(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, moments) of every reply file, fenced or not."""
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(reply_tags(F.col("value"))).alias("track_id", "moments"))
    return pairs.filter(F.col("moments").isNotNull())


def apply_tags(library: DataFrame, tags: DataFrame) -> DataFrame:
    """Library with the moments the replies give; unknown ids are ignored, untouched tracks keep theirs."""
    given = tags.groupBy("track_id").agg(F.max_by("moments", F.size("moments")).alias("_given"))
    return library.join(given, "track_id", "left").withColumn("moments", F.coalesce("_given", "moments")).drop("_given")
