"""The best of all spans that hold a point, per owner: for every probe the span of greatest weight (ties: smallest item).

The instants of all owners are cut into chunks of about ``CHUNK_MARKS`` marks, so a busy owner or hour gets many. A span counts in the
chunk where it begins and in that where it ends; for all chunks in between it is the same everywhere, so there it is noted
at the few nodes of a binary tree over the chunks that cover them, and a node keeps its best span only. A chunk then knows
its own spans and the best of its tree path, and one sweep over its marks in order of time answers its probes. No probe is paired
with a span or an item.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from activity_engine.session import durable

CHUNK_MARKS = 200_000
#: Nodes of the tree above a chunk.
LEVELS = 24


def _borders(marks: DataFrame, chunk_marks: int) -> list[tuple]:
    """(owner, instant) at which each chunk but the first begins: as many rows as chunks."""
    chunks = max(1, -(-marks.count() // chunk_marks))
    ranged = marks.repartitionByRange(chunks, "owner", "at").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("owner", "at")).alias("m"))
    return sorted((r.m.owner, r.m.at) for r in ranged.collect())[1:]


def _located(df: DataFrame, columns: dict[str, str], borders: list[tuple]) -> DataFrame:
    """``df`` with the chunk of each instant column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = batch.column("owner").to_pylist()
            found = [pa.array([bisect_right(borders, x) for x in zip(owners, batch.column(c).to_pylist())], pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *columns.values()])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in columns.values()]]))


def _cover(first: Column, last: Column) -> Column:
    """Nodes (level, place) whose chunks are exactly ``first`` to ``last``; none where ``last`` is before ``first``.

    At each level the left end is taken if it is a right child, the right end if it is a left one, as in a segment tree.
    """
    nothing = F.array().cast("array<struct<level:int,place:bigint>>")

    def node(level: Column, place: Column) -> Column:
        return F.array(F.struct(level.cast("int").alias("level"), place.alias("place")))

    def step(state: Column, level: Column) -> Column:
        low, high = state["low"], state["high"]
        inside = low <= high
        left, right = inside & (low % 2 == 1), inside & (high % 2 == 0)
        taken = F.concat(state["out"], F.when(left, node(level, low)).otherwise(nothing),
                         F.when(right & ~(left & (low == high)), node(level, high)).otherwise(nothing))
        up = lambda place, skip: F.floor((place + skip) / 2).cast("long")
        return F.struct(F.when(inside, up(low, F.when(left, 1).otherwise(0))).otherwise(low).alias("low"),
                        F.when(inside, up(high, F.when(right, -1).otherwise(0))).otherwise(high).alias("high"), taken.alias("out"))

    start = F.struct(first.cast("long").alias("low"), last.cast("long").alias("high"), nothing.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step)["out"]


def _sweep(rows: list[tuple]) -> Iterator[tuple]:
    """Rows (at, kind, until, loss, item, probe) of one owner and chunk, in order: spans open (kind 0), then probes (1) ask. Yields
    (probe, loss, item) of the probes that any span holds."""
    open_: list[tuple] = []
    for at, kind, until, loss, item, probe in rows:
        if kind == 0:
            heapq.heappush(open_, (loss, item, inf if until is None else until))
            continue
        while open_ and open_[0][2] < at:
            heapq.heappop(open_)
        if open_:
            yield probe, open_[0][0], open_[0][1]


def best_spans(
    probes: DataFrame, spans: DataFrame, owner: str, probe_id: str, at: Column, start: Column, end: Column, weight: Column,
    item: Column, chunk_marks: int = CHUNK_MARKS,
) -> DataFrame:
    """(probe_id, item, weight) of each probe that at least one span of its owner holds, both ends included. Instants and weights
    are integers; spans need an item; rows without an owner or instant hold nothing and find nothing."""
    asked = probes.select(F.col(owner).alias("owner"), F.col(probe_id).alias("probe"), at.cast("long").alias("at"))
    asked = durable(asked.where(F.col("owner").isNotNull() & F.col("at").isNotNull()))
    held = spans.select(F.col(owner).alias("owner"), start.cast("long").alias("start"), end.cast("long").alias("end"),
                        (-weight).cast("long").alias("loss"), item.alias("item"))
    held = durable(held.where("owner is not null and item is not null and start <= end"))
    marks = held.select("owner", F.col("start").alias("at")).unionByName(asked.select("owner", "at"))
    borders = _borders(marks, chunk_marks)
    placed = durable(_located(held, {"start": "first", "end": "last"}, borders))
    asked = durable(_located(asked, {"at": "chunk"}, borders))

    probe_type, item_type = asked.schema["probe"].dataType, held.schema["item"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    begun = placed.select(F.col("first").alias("chunk"), "owner", F.col("start").alias("at"), F.lit(0).alias("kind"),
                          F.when(F.col("first") == F.col("last"), F.col("end")).alias("until"), "loss", "item", none(probe_type).alias("probe"))
    ended = placed.where("first < last").select(
        F.col("last").alias("chunk"), "owner", none("long").alias("at"), F.lit(0).alias("kind"), F.col("end").alias("until"), "loss", "item",
        none(probe_type).alias("probe"))
    nodes = placed.where("first + 1 < last").select(
        "owner", F.explode(_cover(F.col("first") + 1, F.col("last") - 1)).alias("node"), F.struct("loss", "item").alias("best"))
    nodes = nodes.groupBy("owner", "node").agg(F.min("best").alias("best"))
    path = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda level: F.struct(
        level.cast("int").alias("level"), F.floor(F.col("chunk") / F.pow(F.lit(2.0), level)).cast("long").alias("place")))
    here = asked.select("owner", "chunk").distinct().withColumn("node", F.explode(path))
    across = here.join(nodes, ["owner", "node"]).groupBy("chunk", "owner").agg(F.min("best").alias("best")).select(
        "chunk", "owner", none("long").alias("at"), F.lit(0).alias("kind"), none("long").alias("until"), "best.loss", "best.item",
        none(probe_type).alias("probe"))
    questions = asked.select("chunk", "owner", "at", F.lit(1).alias("kind"), none("long").alias("until"), none("long").alias("loss"),
                             none(item_type).alias("item"), "probe")
    rows = begun.unionByName(ended).unionByName(across).unionByName(questions)

    def solve(table: pa.Table) -> pa.Table:
        names = ("owner", "at", "kind", "until", "loss", "item", "probe")
        every = zip(*(table.column(c).to_pylist() for c in names))
        ordered = sorted(every, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))  # what was open before comes first
        found = [x for _, some in groupby(ordered, key=lambda r: r[0]) for x in _sweep([r[1:] for r in some])]
        columns = list(zip(*found)) or [(), (), ()]
        types = (table.schema.field("probe").type, pa.int64(), table.schema.field("item").type)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["probe", "loss", "item"])

    schema = T.StructType([T.StructField("probe", probe_type), T.StructField("loss", T.LongType()), T.StructField("item", item_type)])
    found = rows.groupBy("chunk").applyInArrow(solve, schema)
    return found.select(F.col("probe").alias(probe_id), "item", (-F.col("loss")).alias("weight"))
