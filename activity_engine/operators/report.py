"""Report sections as tidy rows: (section, metric, key, value)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_engine.functions import text as tx
from activity_engine.operators.select import mode_per_group, top_counts, top_long_values
from activity_engine.operators.sessions import sessions
from activity_engine.operators.terms import category_mentions, marker_counts

COLUMNS = ("section", "metric", "key", "value")


def in_period(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; rows without a date are dropped."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def _metrics(section: str, row: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns of a one-row frame as metric rows."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.lit("").alias("key"), F.round(F.col(n).cast("double"), 4).alias("value"))
        for n in names
    ])
    return row.select(F.explode(pairs).alias("_m")).select(F.lit(section).alias("section"), "_m.*")


def _ranking(section: str, metric: str, df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), F.lit(metric).alias("metric"), F.col(key).cast("string").alias("key"),
        F.round(F.col(value).cast("double"), 4).alias("value"),
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def words_section(
    messages: DataFrame, text: str, message_id: Sequence[str], dated: DataFrame, owner: str, ts: str,
    markers: Sequence[str], tics: Sequence[str], names: Sequence[str] = (), gap_seconds: float = 3600.0,
    min_session: int = 15, n_tics: int = 8, n_samples: int = 3,
) -> DataFrame:
    """Volume, mean length, sessions of many messages, share of messages that reason, tics, sample lines."""
    content = tx.redact(F.col(text), names) if names else F.col(text)
    said = messages.withColumn(text, content)
    lowered = F.lower(F.col(text))
    reasons = tx.contains_any(lowered, markers)
    volume = said.agg(
        F.count("*").alias("messages"), F.avg(F.length(text)).alias("avg_chars"),
        F.avg(tx.word_count(F.col(text))).alias("avg_words"), F.count_if(reasons).alias("reasoning"),
        F.try_divide(100.0 * F.count_if(reasons), F.count("*")).alias("reasoning_pct"),
    )
    deep = sessions(dated, owner, ts, gap_seconds).filter(F.col("n_events") >= min_session)
    samples = said.filter(reasons).orderBy(*message_id).limit(n_samples).select(
        tx.preview(F.col(text), 200).alias("sample"), F.length(text).alias("size")
    )
    section = "words"
    return _union([
        _metrics(section, volume, ["messages", "avg_chars", "avg_words", "reasoning", "reasoning_pct"]),
        _metrics(section, deep.agg(F.count("*").alias("deep_sessions")), ["deep_sessions"]),
        _ranking(section, "tic", marker_counts(said, text, tics, n_tics), "marker", "n"),
        _ranking(section, "sample", samples, "sample", "size"),
    ])


def searches_section(searches: DataFrame, query: str, categories: Mapping[str, Sequence[str]], n: int = 15) -> DataFrame:
    """Volume, searches per category, most frequent searches."""
    section = "searches"
    return _union([
        _metrics(section, searches.agg(F.count("*").alias("searches")), ["searches"]),
        _ranking(section, "category", category_mentions(searches, query, categories), "category", "n"),
        _ranking(section, "top", top_long_values(searches, query, n), query, "n"),
    ])


def media_section(
    plays: DataFrame, play_ts: str, artist: str, minutes: Column, views: DataFrame, view_ts: str, show: str,
    watches: DataFrame, watch_ts: str, n: int = 10,
) -> DataFrame:
    """Plays, minutes, peak hour, night share, artists; views, busiest week, shows; watches at night."""
    section = "media"
    one = F.lit(0).alias("_all")
    hours = plays.select(one, F.hour(play_ts).alias("h"))
    weeks = views.select(one, F.weekofyear(view_ts).alias("w"))
    played = plays.agg(
        F.count("*").alias("plays"), F.sum(minutes).alias("minutes"),
        F.try_divide(100.0 * F.count_if(_is_night(play_ts)), F.count("*")).alias("night_pct"),
    )
    watched = watches.agg(
        F.count("*").alias("watches"),
        F.try_divide(100.0 * F.count_if(F.hour(watch_ts).between(0, 5)), F.count("*")).alias("watch_night_pct"),
    )
    return _union([
        _metrics(section, played, ["plays", "minutes", "night_pct"]),
        _ranking(section, "peak_hour", mode_per_group(hours, ["_all"], "h", "hour"), "hour", "n"),
        _ranking(section, "artist", top_counts(plays, [artist], n), artist, "n"),
        _metrics(section, views.agg(F.count("*").alias("views")), ["views"]),
        _ranking(section, "busiest_week", mode_per_group(weeks, ["_all"], "w", "week"), "week", "n"),
        _ranking(section, "show", top_counts(views, [show], n), show, "n"),
        _metrics(section, watched, ["watches", "watch_night_pct"]),
    ])


def _is_night(ts: str) -> Column:
    from activity_engine.functions.calendar import is_night

    return is_night(F.hour(ts))


def purchases_section(orders: DataFrame, amount: str, category: str, product: str, n: int = 10, n_products: int = 8) -> DataFrame:
    """Orders, money spent, categories, products."""
    section = "purchases"
    spent = F.sum(F.col(amount).cast("decimal(18,4)"))
    return _union([
        _metrics(section, orders.agg(F.count("*").alias("orders"), spent.alias("spent")), ["orders", "spent"]),
        _ranking(section, "category", top_counts(orders, [category], n), category, "n"),
        _ranking(section, "product", top_counts(orders, [product], n_products), product, "n"),
    ])


def timeline(sections: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(date, section) rows of all sections in order of date; rows without a date are dropped.

    Equal rows are told apart for the sort only, so a date that fills a third of the table is still cut into ranges.
    """
    parts = [df.select(F.col(ts).alias("date"), F.lit(name).alias("section")) for name, (df, ts) in sections.items()]
    dated = _union(parts).filter(F.col("date").isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    return dated.orderBy("date", "section", "_row").drop("_row")


def build(sections: Mapping[str, Callable[[], DataFrame]], wanted: Sequence[str]) -> DataFrame:
    """The wanted sections, in the order asked for; a name nobody knows is an error."""
    unknown = [name for name in wanted if name not in sections]
    if unknown or not wanted:
        raise ValueError(f"unknown or no sections: {unknown}")
    return _union([sections[name]() for name in wanted])
