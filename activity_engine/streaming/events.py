"""Event-time streams: repeated events dropped, sessions closed, and results appended to a table.

State is kept only for as long as an event may be late, so both run for ever on any stream. An event that comes later than
``lateness`` behind the newest one seen may be dropped; all others give what the batch operators give, in whatever order and however
often they come, also when a query is stopped and started again from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timely(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Events with an instant, which may come up to ``lateness`` behind the newest one. Set once for all that follows."""
    return stream.where(F.col(ts).isNotNull()).withWatermark(ts, lateness)


def deduplicated(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first arrival of each key among ``timely`` events. Copies are recognised while they come within the lateness."""
    return events.dropDuplicatesWithinWatermark([*keys])


def sessions(events: DataFrame, owner: str, ts: str, gap_seconds: int) -> DataFrame:
    """(owner, start_ts, end_ts, n_events) of every session of ``timely`` events, given out once it can no longer grow. As in the batch
    operator, a silence of exactly the gap still belongs to a session; instants count in microseconds."""
    gap = f"{gap_seconds} seconds 1 microsecond"
    found = events.groupBy(F.col(owner), F.session_window(ts, gap)).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_events"))
    return found.select(owner, "start_ts", "end_ts", "n_events")


def append(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append everything that a stream has to give now to a Parquet table, then stop. Files of a batch that failed are not read:
    the table's own log says which count."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
