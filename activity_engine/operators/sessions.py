"""Gap sessions from time cells.

Two events of an owner in the same cell of width ``gap`` are less than ``gap`` apart, hence in the same session. So
events are first reduced to one row per (owner, cell) with a map-side aggregate, and only these cells are put in
order. An owner has at most (calendar span / gap) cells however many events it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from activity_engine.functions.calendar import epoch_micros


def _cells(df: DataFrame, owner: str, ts: str, gap_seconds: float) -> DataFrame:
    """One row per (owner, cell) with its session number, zero-based in time order."""
    gap = int(gap_seconds * 1_000_000)
    cells = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(owner, F.floor(epoch_micros(F.col(ts)) / gap).alias("_cell"))
        .agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count("*").alias("_n"))
    )
    in_time = Window.partitionBy(owner).orderBy("_cell")
    silence = epoch_micros(F.col("_first")) - epoch_micros(F.lag("_last").over(in_time))
    starts = cells.withColumn("_starts", F.coalesce((silence > gap).cast("long"), F.lit(0).cast("long")))
    return starts.withColumn("session_no", F.sum("_starts").over(in_time)).drop("_starts")


def sessions(df: DataFrame, owner: str, ts: str, gap_seconds: float) -> DataFrame:
    """Sessions per owner: a new one starts after a silence longer than the gap."""
    found = _cells(df, owner, ts, gap_seconds).groupBy(owner, "session_no").agg(
        F.min("_first").alias("start_ts"), F.max("_last").alias("end_ts"), F.sum("_n").alias("n_events")
    )
    start, end = epoch_micros(F.col("start_ts")), epoch_micros(F.col("end_ts"))
    middle = start + F.floor((end - start) / 2)
    return found.withColumn("mid_ts", F.timestamp_micros(middle).cast("timestamp_ntz"))


def with_session(df: DataFrame, owner: str, ts: str, gap_seconds: float) -> DataFrame:
    """Dated rows with the number of their session."""
    gap = int(gap_seconds * 1_000_000)
    cells = _cells(df, owner, ts, gap_seconds).select(owner, "_cell", "session_no")
    rows = df.filter(F.col(ts).isNotNull()).withColumn("_cell", F.floor(epoch_micros(F.col(ts)) / gap))
    return rows.join(cells, [owner, "_cell"]).drop("_cell")
