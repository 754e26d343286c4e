"""Choosing rows: one per key, the best k per group, the most frequent values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from activity_engine.session import durable


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the smallest in ``order``. An aggregate, so copies of a hot key collapse before the shuffle."""
    position = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the largest in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group. Spark keeps k rows per group in each task before it shuffles."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def top_counts(df: DataFrame, keys: Sequence[str], n: int, name: str = "n") -> DataFrame:
    """The ``n`` most frequent values, ties by key."""
    counted = df.groupBy(*keys).agg(F.count("*").alias(name))
    return counted.orderBy(F.desc(name), *keys).limit(n)


def top_long_values(df: DataFrame, text: str, n: int, name: str = "n") -> DataFrame:
    """``top_counts`` for long texts: counted and ranked by digest, and only the winners fetch their text."""
    keyed = df.select(text, F.sha2(text, 256).alias("digest"))
    best = F.broadcast(top_counts(keyed, ["digest"], n, name))  # n rows
    return keyed.join(best, "digest").groupBy("digest", name).agg(F.any_value(text).alias(text))


def mode_per_group(df: DataFrame, groups: Sequence[str], value: str, name: str, count_name: str = "n") -> DataFrame:
    """Most frequent value per group with its count; ties go to the smallest value."""
    counted = df.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    best = F.min_by(F.struct(F.col(value).alias("v"), F.col("_n").alias("n")), F.struct(-F.col("_n"), F.col(value)))
    return counted.groupBy(*groups).agg(best.alias("_b")).select(
        *groups, F.col("_b.v").alias(name), F.col("_b.n").alias(count_name)
    )


def capped_per_source(df: DataFrame, source: str, row_id: str, n: int, seed: int | None = None) -> DataFrame:
    """At most ``n`` rows per source, so no source dominates. ``seed`` draws them by hash; without it by id."""
    order = [F.col(row_id)] if seed is None else [F.xxhash64(F.lit(seed), F.col(row_id)), F.col(row_id)]
    return top_per_group(df, [source], order, n, "_rank").drop("_rank")


def shuffled(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    """A reproducible permutation."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))), F.col(row_id))


def dense_subset(facts: DataFrame, item: str, user: str, min_item: int, min_user: int) -> DataFrame:
    """Facts of items with at least ``min_item`` rows, then of users with at least ``min_user`` of those."""
    items = facts.groupBy(item).count().filter(F.col("count") >= min_item).select(item)
    popular = durable(facts.join(items, item, "left_semi"))  # read for the users and again for the result
    users = popular.groupBy(user).count().filter(F.col("count") >= min_user).select(user)
    return popular.join(users, user, "left_semi")
