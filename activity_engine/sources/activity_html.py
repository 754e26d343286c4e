"""Activity pages: every ``outer-cell`` of the HTML is one record, so big pages are read by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.functions import calendar as cal
from activity_engine.functions import text as tx
from activity_engine.functions import urls

CELL = '<div class="outer-cell'
_LINK = r'(?s)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def plain(html: Column) -> Column:
    return F.trim(tx.html_unescape(F.regexp_replace(html, r"(?s)<[^>]*>", "")))


def links(html: Column) -> Column:
    """Array of (href, text) of the links in document order."""
    hrefs = F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(_LINK), F.lit(2))
    return F.zip_with(hrefs, texts, lambda h, t: F.struct(tx.html_unescape(h).alias("href"), plain(t).alias("text")))


def page_title(html: Column) -> Column:
    return plain(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1))


def activity(spark: SparkSession, path: str, activity_type: str) -> DataFrame:
    """Title, url, author and time of each cell; a cell with neither title nor time is dropped."""
    cells = spark.read.option("lineSep", CELL).text(path).filter(F.col("value").contains("content-cell"))
    content = F.regexp_extract("value", r"(?s)content-cell[^>]*>(.*)$", 1)
    found = cells.select(content.alias("content")).withColumn("links", links(F.col("content")))
    first, second = F.get("links", F.lit(0)), F.get("links", F.lit(1))
    by_author = second["href"].rlike("channel|user|@")
    # Tags become separators, as the date stands in a text piece of its own.
    pieces = tx.html_unescape(F.regexp_replace("content", r"(?s)<[^>]*>", " | "))
    rows = found.select(
        F.coalesce(first["text"], F.lit("")).alias("title"),
        F.coalesce(first["href"], F.lit("")).alias("url"),
        F.when(by_author, second["text"]).otherwise(F.lit("")).alias("author"),
        cal.french_date_millis(pieces).alias("timestamp_ms"),
        F.lit(activity_type).alias("activity_type"), F.lit("google").alias("platform"),
    ).filter((F.col("title") != "") | (F.col("timestamp_ms") != 0))
    return cal.with_event_columns(rows, cal.from_epoch_millis(F.col("timestamp_ms"))).withColumns({
        "char_count": tx.char_count(F.col("title")), "word_count": tx.word_count(F.col("title"))
    })


def searches(rows: DataFrame) -> DataFrame:
    return rows.withColumn("query", urls.search_query(F.col("url")))


def visits(rows: DataFrame) -> DataFrame:
    return rows.withColumn("domain", urls.domain(F.col("url")))


def watched_videos(rows: DataFrame) -> DataFrame:
    """Videos without advertisements."""
    found = rows.withColumn("video_id", urls.video_id(F.col("url")))
    return found.filter((F.col("video_id") != "") & ~tx.is_ad(F.col("url"), F.col("title")))


def video_searches(rows: DataFrame) -> DataFrame:
    return rows.filter(~tx.is_ad_search(F.col("title")))
