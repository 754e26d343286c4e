"""A left join with one row of facts for each key, whatever share of the rows a key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_engine.llm.blocks import shuffle_partitions
from activity_engine.session import durable


def attach(rows: DataFrame, facts: DataFrame, key: str, count: str, spread: Column, partitions: int | None = None) -> DataFrame:
    """``rows`` with the other columns of ``facts``, which has one row for each string ``key``; null keys meet nothing.

    ``count`` is the column of ``facts`` that says how many of the rows have the key. Facts of keys with over a quarter of a
    partition's share of the rows are broadcast: there are fewer than four times as many as partitions. The others are joined
    by key, where rows of hot keys and those without one are dealt by ``spread``, which should differ from row to row, to
    ``partitions`` partitions (those of the session, if not given).
    """
    parts = partitions or shuffle_partitions(rows)
    names = [c for c in facts.columns if c != key]
    held = durable(facts)
    least = (held.agg(F.sum(count)).first()[0] or 0) // (4 * parts)
    told = F.struct(*names)
    hot = held.where(F.col(count) > least).select(F.col(key).alias("__hot"), told.alias("__told"))
    cold = held.where(F.col(count) <= least).select(F.col(key).alias("__cold"), told.alias("__else"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    alone = F.col("__hot").isNotNull() | F.col(key).isNull()
    met = met.withColumn("__key", F.when(alone, F.concat(F.lit("\x00"), spread.cast("string"))).otherwise(F.col(key)))
    if partitions:
        met = met.repartition(partitions, "__key")
    met = met.join(cold, F.col("__key") == F.col("__cold"), "left").withColumn("__told", F.coalesce("__told", "__else"))
    return met.select(*rows.columns, *[F.col("__told")[n].alias(n) for n in names])
