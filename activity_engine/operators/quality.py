"""Data-quality rules as aggregates: one pass per table, a tidy row per rule."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule on one column; ``violated`` is true for a bad row. A null only violates ``not_null``."""

    column: str
    name: str
    violated: Column


def not_null(column: str) -> Rule:
    return Rule(column, "not_null", F.col(column).isNull())


def positive(column: str) -> Rule:
    return Rule(column, "positive", F.col(column) <= 0)


def at_least(column: str, bound: float) -> Rule:
    return Rule(column, "at_least", F.col(column) < bound)


def one_of(column: str, values: Sequence) -> Rule:
    return Rule(column, "one_of", ~F.col(column).isin(*values))


def castable(column: str, kind: str) -> Rule:
    return Rule(column, "castable", F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull())


def check_rules(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """(table, column, rule, violations, passed) for all rules of a table, from one aggregate."""
    counted = df.agg(*[F.count_if(r.violated).alias(f"r{i}") for i, r in enumerate(rules)])
    rows = F.array(*[
        F.struct(F.lit(r.column).alias("column"), F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("violations"))
        for i, r in enumerate(rules)
    ])
    return counted.select(F.explode(rows).alias("_r")).select(
        F.lit(table).alias("table_name"), "_r.*", (F.col("_r.violations") == 0).alias("passed")
    )


def check_required(df: DataFrame, table: str, columns: Sequence[str], min_rows: int) -> DataFrame:
    """(table, status, detail): missing columns, or too few rows, or OK with the row count."""
    missing = [c for c in columns if c not in df.columns]
    counted = df.agg(F.count("*").alias("n"))
    status = F.lit("FAIL") if missing else F.when(F.col("n") >= min_rows, "OK").otherwise("FAIL")
    detail = F.lit("missing: " + ", ".join(missing)) if missing else F.concat(F.col("n").cast("string"), F.lit(" rows"))
    return counted.select(F.lit(table).alias("table_name"), status.alias("status"), detail.alias("detail"))


def check_unique(df: DataFrame, table: str, keys: Sequence[str], tolerance: int = 0) -> DataFrame:
    """(table, key, duplicates, passed); duplicates are rows beyond the first of their key.

    Counted by grouping, so copies of one key meet as partial counts. Null keys count as equal.
    """
    copies = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    surplus = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")
    return copies.agg(surplus).select(
        F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("key"), "duplicates",
        (F.col("duplicates") <= tolerance).alias("passed"),
    )


def check_time(df: DataFrame, table: str, ts: str, not_after: Column, min_days: int) -> DataFrame:
    """(table, first, last, days, in_past, long_enough)."""
    span = df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    days = F.date_diff(F.to_date("last_ts"), F.to_date("first_ts"))
    return span.select(
        F.lit(table).alias("table_name"), "first_ts", "last_ts", days.alias("days"),
        (F.col("last_ts") <= not_after).alias("in_past"), (days >= min_days).alias("long_enough"),
    )


def check_orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str, table: str) -> DataFrame:
    """(table, orphans): rows whose key is missing from the parent table."""
    parents = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.select(key).join(parents, key, "left_anti").agg(F.count("*").alias("orphans")).select(
        F.lit(table).alias("table_name"), F.lit(key).alias("key"), "orphans"
    )
