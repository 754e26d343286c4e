"""Microblog exports: JavaScript files that assign a JSON array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.functions import calendar as cal
from activity_engine.functions import text as tx
from activity_engine.sources.records import json_records

PLATFORM = "twitter"
_POST = (
    "full_text:string,text:string,created_at:string,id_str:string,lang:string,retweet_count:string,favorite_count:string,"
    "in_reply_to_status_id_str:string,entities:struct<urls:array<struct<expanded_url:string>>,"
    "hashtags:array<struct<text:string>>,user_mentions:array<struct<screen_name:string>>,media:array<string>>"
)


def wrapped_rows(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Elements of the wrapped array, column ``e`` of type ``struct<element>``; a large file is read by many tasks."""
    return json_records(spark, path).select(F.from_json("record", f"struct<{element}>").alias("e")).where("e is not null")


def _joined(array: str, field: str, lower: bool = False) -> Column:
    names = F.transform(F.coalesce(F.col(array), F.array()), lambda x: F.coalesce(x[field], F.lit("")))
    text = F.array_join(names, " ")
    return F.lower(text) if lower else text


def tweets(spark: SparkSession, path: str) -> DataFrame:
    """Posts with their text without leading mentions; items come wrapped in ``tweet`` or bare."""
    rows = wrapped_rows(spark, path, f"tweet:struct<{_POST}>,{_POST}")
    bare = F.struct(*[F.col(f"e.{part.split(':', 1)[0]}") for part in _top_fields(_POST)])
    posts = rows.select(F.coalesce("e.tweet", bare).alias("t")).select("t.*")
    raw = F.coalesce("full_text", "text", F.lit(""))
    clean = tx.strip_mentions(raw)
    flat = posts.select(
        F.coalesce("id_str", F.lit("")).alias("tweet_id"), clean.alias("text"), raw.alias("raw_text"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("created_at", F.lit("")).alias("created_at"),
        F.coalesce(F.col("retweet_count").try_cast("int"), F.lit(0)).alias("retweet_count"),
        F.coalesce(F.col("favorite_count").try_cast("int"), F.lit(0)).alias("favorite_count"),
        raw.startswith("RT @").alias("is_retweet"),
        (F.length(F.coalesce("in_reply_to_status_id_str", F.lit(""))) > 0).alias("is_reply"),
        F.coalesce(F.size("entities.media") > 0, F.lit(False)).alias("has_media"),
        _joined("entities.hashtags", "text", lower=True).alias("hashtags"),
        _joined("entities.user_mentions", "screen_name").alias("mentions"),
        _joined("entities.urls", "expanded_url").alias("urls"),
        tx.char_count(clean).alias("char_count"), tx.word_count(clean).alias("word_count"),
        F.coalesce(F.unix_millis(cal.parse_post_date(F.col("created_at"))), F.lit(0).cast("long")).alias("timestamp_ms"),
    )
    return cal.with_event_columns(flat, cal.from_epoch_millis(F.col("timestamp_ms"))).withColumn("platform", F.lit(PLATFORM))


def _top_fields(fields: str) -> list[str]:
    """Top-level ``name:type`` parts of a struct body."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(fields[start:i])
            start = i + 1
    return [*parts, fields[start:]]


def likes(spark: SparkSession, path: str) -> DataFrame:
    like = "tweetId:string,fullText:string,expandedUrl:string"
    rows = wrapped_rows(spark, path, f"like:struct<{like}>,{like}")

    def field(name: str) -> Column:
        return F.coalesce(f"e.like.{name}", f"e.{name}", F.lit(""))

    return rows.select(
        field("tweetId").alias("tweet_id"), field("fullText").alias("full_text"), field("expandedUrl").alias("post_url"),
        F.lit(PLATFORM).alias("platform"), F.lit("like").alias("action_type"),
        tx.char_count(field("fullText")).alias("char_count"), tx.word_count(field("fullText")).alias("word_count"),
    )


def saved_searches(spark: SparkSession, path: str) -> DataFrame:
    rows = wrapped_rows(spark, path, "savedSearch:struct<query:string>,query:string")
    query = F.coalesce(F.nullif("e.savedSearch.query", F.lit("")), "e.query", F.lit(""))
    return rows.select(query.alias("query"), F.lit(PLATFORM).alias("platform")).filter(F.col("query") != "")
