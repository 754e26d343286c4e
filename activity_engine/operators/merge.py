"""Keyed merges of a batch into a table, as plain DataFrame plans (the warehouse writes their results)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.operators.select import first_per_key


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def absent_rows(batch: DataFrame, target: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key the target lacks, one per key. Null keys equal null keys."""
    unique = first_per_key(batch, keys, order)
    return unique.join(target.select(*keys), null_safe(unique, target, keys), "left_anti")


def insert_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return target.unionByName(absent_rows(batch, target, keys, order))


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Target rows the batch does not touch, and the batch, one row per key."""
    unique = first_per_key(batch, keys, order)
    kept = target.join(unique.select(*keys), null_safe(target, unique, keys), "left_anti")
    return kept.unionByName(unique)


def surviving_versions(files: DataFrame, keys: Sequence[str], sequence: str, latest_wins: str, tie: str) -> DataFrame:
    """One version per key: the latest where the ``latest_wins`` column says so, else the first that arrived."""
    rank = F.when(F.col(latest_wins), -F.col(sequence)).otherwise(F.col(sequence))
    return first_per_key(files, keys, [rank, tie])


def refresh_tags(new: DataFrame, old: DataFrame, key: str, tags: str) -> DataFrame:
    """New rows; where a new row has no tags the old ones stay."""
    kept = old.select(key, F.col(tags).alias("_old"))
    has_new = F.size(F.coalesce(F.col(tags), F.array())) > 0
    return new.join(kept, key, "left").withColumn(
        tags, F.when(has_new, F.col(tags)).otherwise(F.coalesce("_old", F.col(tags)))
    ).drop("_old")
