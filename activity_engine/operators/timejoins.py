"""Joins on time: counts in a window, spans against events, most frequent item nearby, nearest instant, cascades."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.functions.calendar import epoch_micros
from activity_engine.operators.ordered import OrderedRows
from activity_engine.operators.select import first_per_key
from activity_engine.operators.stabbing import CHUNK_MARKS, best_spans

_MICROS = 1_000_000


def window_counts(
    probes: DataFrame, events: DataFrame, keys: Sequence[str], probe_id: Sequence[str], ts: str, seconds: float,
    name: str = "n",
) -> DataFrame:
    """Events within ``seconds`` before and after each probe, both ends included, without forming a pair.

    Each probe becomes two marks in the ordered stream of its key; the count is the difference of the running event
    count at the marks. Work is linear in probes + events whatever the density.
    """
    width = int(seconds * _MICROS)
    at = epoch_micros(F.col(ts))
    identity = [F.col(c) for c in probe_id]
    nothing = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probe_id]
    counted = events.groupBy(*keys, at.alias("_at")).agg(F.count("*").alias("_n"))
    stream = counted.select(*keys, "_at", F.lit(1).alias("_kind"), "_n", *nothing)
    marks = [
        probes.select(*keys, (at + shift).alias("_at"), F.lit(kind).alias("_kind"), F.lit(0).cast("long").alias("_n"), *identity)
        for kind, shift in ((0, -width), (2, width))
    ]
    rows = OrderedRows(reduce(DataFrame.unionByName, [stream, *marks]), keys, ["_at", "_kind", *probe_id])
    totals = rows.running_sum(F.col("_n"), "_upto").result().filter(F.col("_kind") != 1)
    low, high = F.when(F.col("_kind") == 0, F.col("_upto")), F.when(F.col("_kind") == 2, F.col("_upto"))
    grouping = [*keys, *[c for c in probe_id if c not in keys]]
    return totals.groupBy(*grouping).agg((F.max(high) - F.max(low)).alias(name))


def span_join(
    spans: DataFrame, events: DataFrame, owner: str, start: str, end: str, ts: str, seconds: float
) -> DataFrame:
    """Every event inside a span widened by ``seconds`` on both sides. The pairs are the result.

    Spans are spread over the time cells they touch; events stay one row each, so the join is an equi-join on
    (owner, cell) and each pair is met once. Skewed cells are split by the adaptive skew join.
    """
    width = int(seconds * _MICROS)
    low = epoch_micros(F.col(start)) - width
    high = epoch_micros(F.col(end)) + width
    spread = spans.withColumns({"_low": low, "_high": high}).withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width)))
    )
    at = epoch_micros(F.col(ts))
    located = events.withColumns({"_at": at, "_cell": F.floor(at / width)})
    inside = (F.col("_at") >= F.col("_low")) & (F.col("_at") <= F.col("_high"))
    return spread.join(located, [owner, "_cell"]).filter(inside).drop("_cell", "_low", "_high", "_at")


def item_spans(events: DataFrame, owner: str, ts: str, item: str, seconds: float) -> DataFrame:
    """(owner, item, start, end, n): from when to when (in microseconds, both included) a window of ``seconds`` to either side holds
    n events of the item. At most two spans for an event, however dense they are."""
    width = int(seconds * _MICROS)
    at = epoch_micros(F.col(ts))
    counted = events.where(F.col(ts).isNotNull() & F.col(owner).isNotNull() & F.col(item).isNotNull()).groupBy(
        owner, item, at.alias("_s")).agg(F.count("*").alias("_n"))
    change = F.explode(F.array(F.struct((F.col("_s") - width).alias("at"), F.col("_n").alias("n")),
                               F.struct((F.col("_s") + width + 1).alias("at"), (-F.col("_n")).alias("n"))))
    changes = counted.select(owner, item, change.alias("_c")).groupBy(owner, item, F.col("_c.at").alias("_at")).agg(F.sum("_c.n").alias("_d"))
    rows = OrderedRows(changes, [owner, item], ["_at"]).running_sum(F.col("_d"), "_now").lag(F.struct("_at", "_now"), "_before")
    return rows.result().where("_before._now > 0").select(
        owner, item, F.col("_before._at").alias("start"), (F.col("_at") - 1).alias("end"), F.col("_before._now").alias("n"))


def modal_item_nearby(
    probes: DataFrame, events: DataFrame, owner: str, probe_id: str, ts: str, item: str, seconds: float,
    chunk_marks: int = CHUNK_MARKS,
) -> DataFrame:
    """Most frequent item within the window around each probe (ties: smallest item), with its count.

    Seen from the probes, an item's count is a step function of time: each step is a span that holds the probes for which the
    count is right. The answer is the best span at the probe's instant (see ``stabbing``), so the work follows the number of
    events and probes, not their pairs, and does not depend on how rare the items are.
    """
    spans = item_spans(events, owner, ts, item, seconds).withColumnRenamed(item, "_item")
    found = best_spans(probes, spans, owner, probe_id, epoch_micros(F.col(ts)), F.col("start"), F.col("end"), F.col("n"), F.col("_item"), chunk_marks)
    return found.select(probe_id, F.col("item").alias(item), F.col("weight").alias("n"))


def nearest_in_time(
    probes: DataFrame, marks: DataFrame, keys: Sequence[str], probe_id: str, mark_id: str, ts: str
) -> DataFrame:
    """Mark closest in time to each probe of the same key; ties go to the smaller mark id. No match gives null."""
    at = epoch_micros(F.col(ts)).alias("_at")
    unique = marks.groupBy(*keys, at).agg(F.min(mark_id).alias(mark_id))
    id_type = marks.schema[mark_id].dataType
    probe_type = probes.schema[probe_id].dataType
    stream = unique.select(
        *keys, "_at", F.lit(0).alias("_kind"), F.lit(None).cast(probe_type).alias(probe_id),
        F.struct("_at", F.col(mark_id).alias("id")).alias("_mark"),
    ).unionByName(
        probes.select(
            *keys, at, F.lit(1).alias("_kind"), probe_id,
            F.lit(None).cast(f"struct<_at:bigint,id:{id_type.simpleString()}>").alias("_mark"),
        )
    )
    rows = OrderedRows(stream, keys, ["_at", "_kind", probe_id])
    rows.last_known(F.col("_mark"), "_before").next_known(F.col("_mark"), "_after")
    found = rows.result().filter(F.col("_kind") == 1)
    back, ahead = F.col("_at") - F.col("_before._at"), F.col("_after._at") - F.col("_at")
    use_back = (
        F.col("_after").isNull() | (back < ahead) | ((back == ahead) & (F.col("_before.id") < F.col("_after.id")))
    ) & F.col("_before").isNotNull()
    return found.select(
        *keys, probe_id,
        F.when(use_back, F.col("_before.id")).otherwise(F.col("_after.id")).alias(mark_id),
        (F.when(use_back, back).otherwise(ahead) / _MICROS).alias("distance_seconds"),
    )


def cascade(probes: DataFrame, probe_id: str, levels: Sequence[tuple[str, DataFrame]], columns: Sequence[str]) -> DataFrame:
    """First level that knows a probe wins; ``match_type`` names it, ``none`` when no level does.

    ``levels`` hold at most one row per probe id, in order of priority.
    """
    ranked = [
        level.select(probe_id, *columns).withColumns({"match_type": F.lit(name), "_level": F.lit(i)})
        for i, (name, level) in enumerate(levels)
    ]
    best = first_per_key(reduce(DataFrame.unionByName, ranked), [probe_id], ["_level"]).drop("_level")
    return probes.join(best, probe_id, "left").withColumn("match_type", F.coalesce("match_type", F.lit("none")))
