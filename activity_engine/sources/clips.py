"""Short-video export: one JSON object holding every list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.functions import calendar as cal
from activity_engine.functions import text as tx
from activity_engine.functions import urls

PLATFORM = "tiktok"
_SCHEMA = (
    "`Your Activity` struct<`Watch History`:struct<VideoList:array<struct<Link:string,Date:string>>>,"
    "Searches:struct<SearchList:array<struct<SearchTerm:string,Date:string>>>>, "
    "`Likes and Favorites` struct<`Like List`:struct<ItemFavoriteList:array<struct<link:string,date:string>>>,"
    "`Favorite Videos`:struct<FavoriteVideoList:array<struct<Link:string,Date:string>>>,"
    "`Favorite Hashtags`:struct<FavoriteHashtagList:array<struct<HashtagName:string,hashtag:string>>>>, "
    "Comment struct<Comments:struct<CommentsList:array<struct<comment:string,url:string,date:string>>>>, "
    "`Direct Message` struct<`Direct Messages`:struct<ChatHistory:map<string,string>>>, "
    "Ads struct<Interests:string>"
)
_CHAT = "array<struct<Date:string,From:string,Content:string>>"

# Path of the list, name of its link and date fields.
ACTIONS = {
    "watch": ("`Your Activity`.`Watch History`.VideoList", "Link", "Date"),
    "like": ("`Likes and Favorites`.`Like List`.ItemFavoriteList", "link", "date"),
    "save": ("`Likes and Favorites`.`Favorite Videos`.FavoriteVideoList", "Link", "Date"),
}


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).option("multiLine", True).json(path)


def _dated(df: DataFrame) -> DataFrame:
    return cal.with_event_columns(df, cal.from_epoch_millis(F.col("timestamp_ms"))).withColumn("platform", F.lit(PLATFORM))


def _or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def actions(export: DataFrame, action: str) -> DataFrame:
    path, link, date = ACTIONS[action]
    rows = export.select(F.explode(path).alias("i")).select(
        _or_empty(F.col(f"i.{link}")).alias("url"), cal.parse_millis(F.col(f"i.{date}")).alias("timestamp_ms")
    )
    return _dated(rows.withColumns({"video_id": urls.clip_id(F.col("url")), "action_type": F.lit(action)}))


def searches(export: DataFrame) -> DataFrame:
    rows = export.select(F.explode("`Your Activity`.Searches.SearchList").alias("i")).select(
        _or_empty(F.col("i.SearchTerm")).alias("query"), cal.parse_millis(F.col("i.Date")).alias("timestamp_ms")
    )
    return _dated(rows.withColumns({
        "char_count": tx.char_count(F.col("query")), "word_count": tx.word_count(F.col("query"))
    }))


def comments(export: DataFrame) -> DataFrame:
    rows = export.select(F.explode("Comment.Comments.CommentsList").alias("i")).select(
        _or_empty(F.col("i.comment")).alias("text"), _or_empty(F.col("i.url")).alias("url"),
        cal.parse_millis(F.col("i.date")).alias("timestamp_ms"),
    )
    return _dated(rows.withColumns({
        "char_count": tx.char_count(F.col("text")), "word_count": tx.word_count(F.col("text")),
        "content_type": F.lit("comment"),
    }))


def messages(export: DataFrame, me: str) -> DataFrame:
    """All direct messages. A conversation whose value is not a list is left out."""
    threads = export.select(F.explode("`Direct Message`.`Direct Messages`.ChatHistory").alias("conversation", "raw"))
    listed = threads.filter(F.col("raw").startswith("[")).select("conversation", F.explode(F.from_json("raw", _CHAT)).alias("m"))
    content = _or_empty(F.col("m.Content"))
    return listed.select(
        "conversation", _or_empty(F.col("m.From")).alias("sender"),
        F.coalesce(F.col("m.From") == me, F.lit(False)).alias("is_me"),
        cal.parse_millis(F.col("m.Date")).alias("timestamp_ms"), content.alias("text"),
        tx.message_type({"url": content.startswith("http")}, content).alias("msg_type"),
        F.length(content).alias("char_count"),
    )


def message_meta(rows: DataFrame, salt: str) -> DataFrame:
    hidden = rows.select(
        tx.pseudonym(F.col("conversation"), salt).alias("conv_id"), tx.pseudonym(F.col("sender"), salt).alias("sender_anon"),
        "is_me", "timestamp_ms", "msg_type", "char_count",
    )
    return _dated(hidden)


def own_text(rows: DataFrame) -> DataFrame:
    own = rows.filter(F.col("is_me") & (F.col("msg_type") == "text")).select("text", "timestamp_ms")
    return _dated(own.withColumns({
        "char_count": tx.char_count(F.col("text")), "word_count": tx.word_count(F.col("text")), "content_type": F.lit("dm"),
    }))


def hashtags(export: DataFrame) -> DataFrame:
    tags = export.select(F.explode("`Likes and Favorites`.`Favorite Hashtags`.FavoriteHashtagList").alias("h"))
    named = tags.select(F.coalesce(F.nullif("h.HashtagName", F.lit("")), "h.hashtag", F.lit("")).alias("hashtag"))
    return named.filter(F.col("hashtag") != "").withColumn("platform", F.lit(PLATFORM))


def ad_interests(export: DataFrame) -> DataFrame:
    """Interests given as a list of names, a list of objects, or an object holding such a list."""
    raw = F.coalesce(F.get_json_object("Ads.Interests", "$.adInterestCategories"), F.col("Ads.Interests"))
    entries = export.select(F.explode(F.from_json(raw, "array<string>")).alias("e"))
    named = F.coalesce(
        F.nullif(F.get_json_object("e", "$.Name"), F.lit("")), F.get_json_object("e", "$.category"),
        F.when(~F.col("e").startswith("{"), F.col("e")), F.lit(""),
    )
    return entries.select(named.alias("category")).filter(F.col("category") != "").withColumn("platform", F.lit(PLATFORM))
