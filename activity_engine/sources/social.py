"""Social network exports: comments, likes, messages and the lists that come in two shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.functions import calendar as cal
from activity_engine.functions import text as tx

_ITEM = "string_map_data map<string,struct<value:string,timestamp:long,href:string>>, title string, timestamp long"
_LIKES = "timestamp long, label_values array<struct<label:string,value:string,href:string>>"
_MESSAGES = (
    "participants array<struct<name:string>>, messages array<struct<sender_name:string,timestamp_ms:long,content:string,"
    "photos:array<string>,videos:array<string>,audio_files:array<string>,files:array<string>,share:string,"
    "is_unsent:boolean,call_duration:long>>"
)
PLATFORM = "instagram"


def existing(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Files of the first pattern that matches any."""
    jvm = spark._jvm
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if found:
            return sorted(f.getPath().toString() for f in found)
    return []


def _seconds(df: DataFrame) -> DataFrame:
    return cal.with_event_columns(df, cal.from_epoch_seconds(F.col("timestamp"))).withColumn("platform", F.lit(PLATFORM))


def _value(name: str, part: str, default) -> Column:
    field = F.try_element_at("string_map_data", F.lit(name))[part]
    return F.coalesce(field, F.lit(default))


def items(spark: SparkSession, paths: str | Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Items of files that hold a list of them, or an object with the list under one of ``keys``."""
    inner = "struct<string_map_data:map<string,struct<value:string,timestamp:long,href:string>>,title:string,timestamp:long>"
    wrapped = "".join(f", `{k}` array<{inner}>" for k in keys)
    read = spark.read.schema(_ITEM + wrapped).option("multiLine", True).json(paths)
    columns = ["string_map_data", "title", "timestamp"]
    lists = F.coalesce(*[F.col(f"`{k}`") for k in keys]) if keys else F.lit(None)
    bare = F.array(F.struct(*columns))
    return read.select(F.explode(F.coalesce(lists, bare)).alias("i")).select("i.*")


def comments(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    found = items(spark, paths, ["comments_media_comments"]).select(
        _value("Comment", "value", "").alias("text"), _value("Media Owner", "value", "").alias("media_owner"),
        _value("Time", "timestamp", 0).cast("long").alias("timestamp"),
    ).filter(F.col("text") != "")
    text = F.col("text")
    return _seconds(found).withColumns({
        "char_count": tx.char_count(text), "word_count": tx.word_count(text),
        "nonascii_token_count": tx.nonascii_token_count(text), "emoji_count": tx.emoji_count(text),
        "content_type": F.lit("comment"),
    })


def likes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    read = spark.read.schema(_LIKES).option("multiLine", True).json(paths)
    link = F.get(F.filter("label_values", lambda v: v["label"] == "URL"), F.lit(0))
    rows = read.select(
        F.coalesce("timestamp", F.lit(0).cast("long")).alias("timestamp"),
        F.coalesce(link["value"], link["href"], F.lit("")).alias("post_url"),
    )
    return _seconds(rows).withColumn("action_type", F.lit("like"))


# Names of the list inside a file, and the action its items stand for.
LISTS = {
    "posts_viewed": (["impressions_history_posts_seen"], "view"),
    "videos_watched": (["impressions_history_videos_watched"], "watch"),
    "story_likes": (["story_activities_story_likes", "story_likes"], "story_like"),
}


def activity_list(spark: SparkSession, paths: str | Sequence[str], kind: str) -> DataFrame:
    """Viewed posts, watched videos or story likes: when. Items without a time are dropped."""
    keys, action = LISTS[kind]
    rows = items(spark, paths, keys).filter(F.col("timestamp") > 0).select(F.lit("").alias("author"), "timestamp")
    return _seconds(rows).withColumn("action_type", F.lit(action))


def saved(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    rows = items(spark, paths, ["saved_saved_media"]).select(
        F.coalesce("title", F.lit("")).alias("account"), _value("Saved on", "href", "").alias("post_href"),
        _value("Saved on", "timestamp", 0).cast("long").alias("timestamp"),
    )
    return _seconds(rows).withColumn("action_type", F.lit("save"))


def _first_field(names: Sequence[str], part: str) -> Column:
    return F.coalesce(*[F.try_element_at("string_map_data", F.lit(n))[part] for n in names])


def searches(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    query = F.coalesce(F.nullif(_first_field(["Recherche", "Search"], "value"), F.lit("")), F.col("title"))
    rows = items(spark, paths, ["searches_keyword", "keyword_searches"]).select(
        query.alias("query"), _first_field(["Heure", "Time"], "timestamp").alias("timestamp")
    ).filter((F.length("query") > 0) & (F.col("timestamp") > 0))
    return _seconds(rows).withColumns({
        "char_count": tx.char_count(F.col("query")), "word_count": tx.word_count(F.col("query"))
    })


def messages(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All messages of all threads: one row per message with its thread, sender, text and kind."""
    read = spark.read.schema(_MESSAGES).option("multiLine", True).json(paths)
    rows = read.select(
        F.element_at(F.split(F.input_file_name(), "/"), -2).alias("conversation"),
        F.size(F.coalesce("participants", F.array())).alias("participants"), F.explode("messages").alias("m"),
    )
    filled = {
        "photo": F.size("m.photos") > 0, "video": F.size("m.videos") > 0, "audio": F.size("m.audio_files") > 0,
        "share": F.col("m.share").isNotNull(),
    }
    content = F.coalesce("m.content", F.lit(""))
    attached = F.coalesce(filled["photo"], F.lit(False)) | F.coalesce(filled["video"], F.lit(False)) | F.coalesce(
        filled["audio"], F.lit(False)) | filled["share"] | F.coalesce(F.size("m.files") > 0, F.lit(False))
    return rows.select(
        "conversation", "participants", (F.col("participants") > 2).alias("is_group"),
        tx.fix_mojibake(F.col("m.sender_name")).alias("sender"), F.col("m.timestamp_ms").alias("timestamp_ms"),
        tx.fix_mojibake(content).alias("text"),
        tx.message_type({"unsent": F.col("m.is_unsent")} | filled, content).alias("msg_type"),
        F.length(content).alias("char_count"),
        (attached | F.col("m.call_duration").isNotNull()).alias("has_attachment"),
    )


def message_meta(rows: DataFrame, salt: str) -> DataFrame:
    """Who wrote when, without names or text."""
    hidden = rows.select(
        tx.pseudonym(F.col("conversation"), salt).alias("conv_id"), "is_group", "participants",
        tx.pseudonym(F.coalesce("sender", F.lit("")), salt).alias("sender_anon"), "timestamp_ms", "msg_type", "char_count",
    )
    dated = cal.with_event_columns(hidden, cal.from_epoch_millis(F.col("timestamp_ms")))
    return dated.withColumn("platform", F.lit(PLATFORM))


def conversation_text(rows: DataFrame) -> DataFrame:
    """Messages that are conversation: text, nothing attached, not written by the system."""
    return rows.filter(~F.col("has_attachment") & ~tx.is_chat_noise(F.col("text")))
