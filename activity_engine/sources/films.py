"""Film history: a two-column CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.functions import calendar as cal
from activity_engine.functions.titles import title_parts


def views(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.schema("Title string, Date string").option("header", True).option("encoding", "UTF-8").csv(path)
    dated = read.withColumn("watch_date", F.try_to_date("Date", cal.SHORT_US_DATE))
    parts = {
        name.replace("event_", "watch_"): value
        for name, value in cal.calendar_parts(F.col("watch_date")).items() if name != "event_hour"
    }
    return dated.withColumns(title_parts(F.col("Title")) | parts).withColumnRenamed("Title", "raw_title").drop("Date")
