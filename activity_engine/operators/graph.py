"""Ego network: one centre, one node per contact, weighted edges, conversation statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_engine.operators.select import mode_per_group


def contact_strength(
    messages: DataFrame, contact: str, close: DataFrame, minimum: int = 5, multiplier: float = 2.0
) -> DataFrame:
    """Contacts with at least ``minimum`` messages; those listed in ``close`` weigh ``multiplier`` times as much."""
    counted = messages.groupBy(contact).agg(F.count("*").alias("message_count")).filter(F.col("message_count") >= minimum)
    listed = close.select(contact).distinct().withColumn("is_close", F.lit(True))
    flagged = counted.join(listed, contact, "left").withColumn("is_close", F.coalesce("is_close", F.lit(False)))
    factor = F.when(F.col("is_close"), multiplier).otherwise(1.0)
    return flagged.withColumn("weight", F.col("message_count") * factor)


def scaled_nodes(contacts: DataFrame, count: str = "message_count") -> DataFrame:
    """Node size and edge width by the share of the largest count; close contacts are drawn larger."""
    largest = contacts.agg(F.max(count)).scalar()
    ratio = F.col(count) / largest
    size = F.when(F.col("is_close"), F.floor(20 + 44 * ratio)).otherwise(F.floor(1 + 11 * ratio))
    return contacts.withColumns({"size": size.cast("int"), "width": F.round(0.8 + F.floor(2 * ratio), 1)})


def ego_nodes(contacts: DataFrame, contact: str, me: Column, centre_size: int = 80) -> DataFrame:
    """Nodes of the contacts and, once per centre, of the centre itself."""
    scaled = scaled_nodes(contacts)
    around = scaled.select(F.col(contact).cast("string").alias("node_id"), "is_close", "message_count", "size")
    centre = contacts.select(me.cast("string").alias("node_id")).distinct().select(
        "node_id", F.lit(False).alias("is_close"), F.lit(0).cast("long").alias("message_count"),
        F.lit(centre_size).alias("size"),
    )
    return centre.unionByName(around)


def ego_edges(contacts: DataFrame, contact: str, me: Column) -> DataFrame:
    return scaled_nodes(contacts).select(
        me.cast("string").alias("src"), F.col(contact).cast("string").alias("dst"), "is_close", "width"
    )


def conversation_stats(
    messages: DataFrame, keys: Sequence[str], ts: str, sent: Column
) -> DataFrame:
    """First and last instant, messages sent and received, and the busiest month with its count (ties: earliest)."""
    month = F.date_format(ts, "yyyy-MM")
    spans = messages.groupBy(*keys).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count_if(sent).alias("sent"), F.count_if(~sent).alias("received"),
    )
    peak = mode_per_group(messages.withColumn("_month", month), keys, "_month", "peak_month", "peak_count")
    return spans.join(peak, list(keys))


def graph_json(nodes: DataFrame, edges: DataFrame, columns: Sequence[str] = ("node_id", "is_close", "message_count", "size")) -> DataFrame:
    """Nodes and links as JSON lines, (part, json), one line per node or link."""
    return nodes.select(F.lit("nodes").alias("part"), F.to_json(F.struct(*columns)).alias("json")).unionByName(
        edges.select(F.lit("links").alias("part"), F.to_json(F.struct("src", "dst", "is_close", "width")).alias("json"))
    )
