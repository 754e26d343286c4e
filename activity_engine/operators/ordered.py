"""Ordered computations (lag, running totals, as-of values) that never put one key into one task.

A plain ``Window.partitionBy(owner)`` sorts all rows of an owner in a single task, so an owner holding a third of the
table decides the run time. Here the rows are range-partitioned by ``keys + order`` instead: a big owner is spread
over many chunks, each chunk is solved with a local window, and what a chunk needs from the chunks before it (its
*carry*) is computed from one summary row per (key, chunk). Only keys that continue from an earlier chunk get a carry,
and at most one key continues into a chunk, so there are fewer carries than chunks: that is the proven bound behind
the broadcast in ``_attach``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from activity_engine.session import durable

CHUNK = "_chunk"


class OrderedRows:
    """Rows of ``df`` in the total order ``order`` within ``keys``. Each method adds a column and returns self.

    ``order`` must be a total order inside a key: then no single value can fill a chunk.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None):
        self.keys, self.order = list(keys), list(order)
        ranges = [*self.keys, *self.order]
        # Without a number there are at most spark.sql.shuffle.partitions chunks, and small neighbours are merged.
        ranged = df.repartitionByRange(chunks, *ranges) if chunks else df.repartitionByRange(*ranges)
        placed = ranged.withColumn(CHUNK, F.spark_partition_id())
        # Both the rows and the carries are read from this one placement, so it has to be fixed first.
        self.df = durable(placed)

    @property
    def _local(self):
        return Window.partitionBy(CHUNK, *self.keys).orderBy(*self.order)

    @property
    def _chunks(self):
        return Window.partitionBy(*self.keys).orderBy(CHUNK)

    def _position(self) -> Column:
        return F.struct(*self.order)

    def _attach(self, carry: DataFrame, local: Column, name: str, combine, wide: bool = False) -> OrderedRows:
        """Join the (fewer than chunks) carries back and combine them with the local result.

        ``wide`` carries hold several row values each; they take part in an ordinary join on (key, chunk), which
        reuses the partitioning of the local window.
        """
        carry = carry.filter(F.col("_carry").isNotNull()).select(
            F.col(CHUNK).alias("_c"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], "_carry"
        )
        on = F.col(CHUNK) == F.col("_c")
        for i, key in enumerate(self.keys):
            on = on & F.col(key).eqNullSafe(F.col(f"_k{i}"))
        joined = self.df.withColumn("_here", local).join(carry if wide else F.broadcast(carry), on, "left")
        self.df = joined.withColumn(name, combine(F.col("_here"), F.col("_carry"))).drop(
            "_here", "_carry", "_c", *[f"_k{i}" for i in range(len(self.keys))]
        )
        return self

    def lag(self, value: Column, name: str) -> OrderedRows:
        """Value of the row before, null for the first row of a key. Null values are kept as values."""
        box = F.struct(value.alias("v"))
        ends = self.df.groupBy(*self.keys, CHUNK).agg(F.max_by(box, self._position()).alias("_end"))
        carry = ends.withColumn("_carry", F.lag("_end").over(self._chunks))
        local = F.lag(box).over(self._local)
        return self._attach(carry, local, name, lambda here, before: F.coalesce(here, before)["v"])

    def running_sum(self, value: Column, name: str) -> OrderedRows:
        """Sum of ``value`` from the first row of the key up to and including this one."""
        totals = self.df.groupBy(*self.keys, CHUNK).agg(F.sum(value).alias("_total"))
        before = self._chunks.rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.withColumn("_carry", F.sum("_total").over(before))
        local = F.sum(value).over(self._local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return self._attach(carry, local, name, lambda here, earlier: here + F.coalesce(earlier, F.lit(0)))

    def row_number(self, name: str) -> OrderedRows:
        return self.running_sum(F.lit(1).cast("long"), name)

    def last_known(self, value: Column, name: str) -> OrderedRows:
        """Latest non-null ``value`` at or before this row."""
        ends = self.df.groupBy(*self.keys, CHUNK).agg(
            F.max_by(value, F.when(value.isNotNull(), self._position())).alias("_end")
        )
        before = self._chunks.rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before))
        local = F.last(value, ignorenulls=True).over(
            self._local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return self._attach(carry, local, name, F.coalesce)

    def next_known(self, value: Column, name: str) -> OrderedRows:
        """Earliest non-null ``value`` at or after this row.

        Read backwards, as a frame that ends with the partition is evaluated anew for every row.
        """
        starts = self.df.groupBy(*self.keys, CHUNK).agg(
            F.min_by(value, F.when(value.isNotNull(), self._position())).alias("_start")
        )
        backwards = Window.partitionBy(*self.keys).orderBy(F.desc(CHUNK))
        after = backwards.rowsBetween(Window.unboundedPreceding, -1)
        carry = starts.withColumn("_carry", F.last("_start", ignorenulls=True).over(after))
        from_end = Window.partitionBy(CHUNK, *self.keys).orderBy(*[F.desc(c) for c in self.order])
        local = F.last(value, ignorenulls=True).over(
            from_end.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return self._attach(carry, local, name, F.coalesce)

    def preceding(self, value: Column, size: int, name: str) -> OrderedRows:
        """The last ``size`` values before this row, oldest first (fewer at the start of a key)."""
        ranked = self.df.select(
            *self.keys, CHUNK, self._position().alias("_pos"), value.alias("_v"),
            F.row_number().over(Window.partitionBy(CHUNK, *self.keys).orderBy(*[F.desc(c) for c in self.order]))
            .alias("_back"),
        ).filter(F.col("_back") <= size)
        tails = ranked.groupBy(*self.keys, CHUNK).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_v"))), lambda x: x["_v"]).alias("_tail")
        )
        # Every chunk of a key has at least one row, so the last `size` chunks hold the last `size` rows.
        near = self._chunks.rowsBetween(-size, -1)
        carry = tails.withColumn("_carry", F.flatten(F.collect_list("_tail").over(near)))
        carry = carry.withColumn("_carry", F.when(F.size("_carry") > 0, _keep_last(F.col("_carry"), size)))
        local = F.collect_list(value).over(self._local.rowsBetween(-size, -1))
        return self._attach(
            carry, local, name,
            lambda here, before: F.when(
                before.isNotNull() & (F.size(here) < size), _keep_last(F.concat(before, here), size)
            ).otherwise(here),
            wide=True,
        )

    def with_column(self, name: str, value: Column) -> OrderedRows:
        self.df = self.df.withColumn(name, value)
        return self

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK)


def _keep_last(array: Column, size: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - size + 1, F.lit(1)), size)


def number_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "run_no") -> DataFrame:
    """Zero-based number of the run of equal consecutive ``value`` each row belongs to."""
    rows = OrderedRows(df, keys, order).lag(F.struct(F.col(value).alias("is")), "_before")
    starts = F.col("_before").isNotNull() & ~F.col(value).eqNullSafe(F.col("_before")["is"])
    return rows.running_sum(starts.cast("long"), name).result().drop("_before")


def dense_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Zero-based position of every row inside its key."""
    rows = OrderedRows(df, keys, order).row_number("_n").result()
    return rows.withColumn(name, F.col("_n") - 1).drop("_n")


def places(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Zero-based place of every row of a frame in the order it has (``orderBy``): the rows of all partitions before, and those
    before it in its own. The order is settled first, so places and rows cannot part."""
    held = durable(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    begun = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_begun"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_part", part).join(F.broadcast(begun), "_part").withColumn(name, F.col("_begun") + inside).drop("_at", "_part", "_begun")


def percent_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``percent_rank`` of ``value`` within ``keys``: (rows below) / (rows - 1), 0 for a single row.

    Rows are first counted per distinct value, so ties and big keys shrink before anything is ordered. Without keys
    the whole table is ranked.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    below = OrderedRows(counts, keys, [value]).running_sum(F.col("_n"), "_upto").result()
    if keys:
        totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
        below = below.join(totals, list(keys))
    else:
        below = below.withColumn("_total", counts.agg(F.sum("_n")).scalar())
    ranks = below.select(
        *keys, value,
        F.when(F.col("_total") > 1, (F.col("_upto") - F.col("_n")) / (F.col("_total") - 1))
        .otherwise(F.lit(0.0)).alias(name),
    )
    return df.join(ranks, [*keys, value])
