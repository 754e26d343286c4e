"""Cut a corpus into shards of nearly equal bytes without parting equal texts; DataFrame functions only.

Groups of equal texts stand in the order of a 64-bit hash of the text. The smallest capacity for which a greedy walk
over the group sizes needs no more than the wanted shards is found by binary search; cuts are then made at that capacity.

The driver never holds the groups: it holds sums over stretches of the hash that share their leading bits. Only stretches
in which a cut may fall are split further, ``BITS`` bits a round, until each holds a single group. There are six rounds
at most, and each splits a number of stretches that depends on the number of shards only, whatever the corpus holds.
"""

from __future__ import annotations

import operator
from bisect import bisect_right
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from activity_engine.llm.blocks import shuffle_partitions
from activity_engine.session import durable

#: Bits of the hash that one round looks at.
BITS = 12


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size`` (bytes of the text and 1), ``text_crc32`` and the text's hash ``place``; null is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("place"))


def _greedy(ends: list[int], shards: int, capacity: int) -> list[int]:
    """Ends of the fullest shards of at most ``capacity`` each, as places in the running sums ``ends``."""
    cuts, begun = [], 0
    for _ in range(shards):
        cuts.append(bisect_right(ends, begun + capacity))
        begun = ends[cuts[-1] - 1] if cuts[-1] else 0
    return cuts


def least_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity with which ordered ``sizes`` fit into ``shards`` contiguous shards, by binary search."""
    ends = list(accumulate(sizes))
    total = ends[-1] if ends else 0
    low = max([-(-total // shards), *sizes, 0])
    high = max(low, total)
    while low < high:
        middle = (low + high) // 2
        if _greedy(ends, shards, middle)[-1] == len(ends):
            high = middle
        else:
            low = middle + 1
    return low


def balanced_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """First group of each shard but the first. No shard exceeds ``capacity``; each takes its share of what is left, and
    at least what the later shards cannot hold."""
    ends = list(accumulate(sizes))
    total = ends[-1] if ends else 0
    turned = list(accumulate(reversed(sizes)))
    needed = [len(ends) - c for c in _greedy(turned, shards, capacity)]  # needed[j]: where the last j + 1 shards begin at least
    cuts, begun, at = [], 0, 0
    for j in range(shards - 1):
        left = shards - j
        most = bisect_right(ends, begun + capacity)
        goal = begun + -(-(total - begun) // left)
        near = bisect_right(ends, goal)
        if near < len(ends) and (ends[near] - goal) < (goal - (ends[near - 1] if near else 0)):
            near += 1
        at = max(at, min(most, max(near, needed[left - 2])))
        cuts.append(at)
        begun = ends[at - 1] if at else 0
    return cuts


class Stretch(NamedTuple):
    """Groups whose hash shares the bits above ``shift``: the first such hash, their total size, number and largest."""

    low: int
    shift: int
    size: int
    groups: int
    largest: int


def _split(groups: DataFrame, shift: int) -> list[Stretch]:
    """Sums over stretches of ``shift`` free bits."""
    rows = groups.withColumn("part", F.shiftright("place", shift))
    sums = rows.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("groups"), F.max("size").alias("largest"))
    return [Stretch(r["part"] << shift, shift, r["size"], r["groups"], r["largest"]) for r in sums.collect()]


def _unsettled(held: list[Stretch], shards: int) -> list[Stretch]:
    """Stretches of several groups in which some capacity between the bounds, or an even share, may put a cut."""
    sizes = [r.size for r in held]
    ends = list(accumulate(sizes))
    total = ends[-1] if ends else 0
    least = max([-(-total // shards), *(r.largest for r in held)], default=0)
    enough = least_capacity(sizes, shards)  # with whole stretches as groups
    found: set[int] = set()
    for sums, place in ((ends, lambda i: i), (list(accumulate(reversed(sizes))), lambda i: len(sizes) - 1 - i)):
        early = late = 0
        for _ in range(shards if sums else 0):
            first = min(bisect_right(sums, early + least), len(sums) - 1)
            late = min(total, late + enough)
            found.update(place(i) for i in range(first, min(bisect_right(sums, late), len(sums) - 1) + 1))
            early = sums[first - 1] if first else 0
    for j in range(1, shards):
        near = bisect_right(ends, total * j // shards)
        found.update(i for i in (near - 1, near, near + 1) if 0 <= i < len(ends))
    return [held[i] for i in sorted(found) if held[i].groups > 1 and held[i].shift]


def cut_places(groups: DataFrame, shards: int) -> list[int | None]:
    """Hashes at which shards 1, 2, ... begin, None past the last group. ``groups``: (place, size) per distinct text."""
    held = sorted(_split(groups, 64 - BITS))
    while unsettled := _unsettled(held, shards):
        for shift in {r.shift for r in unsettled}:
            wide = [r for r in unsettled if r.shift == shift]
            inner = groups.where(F.shiftright("place", shift).isin([r.low >> shift for r in wide]))
            held = [r for r in held if r not in set(wide)] + _split(inner, max(0, shift - BITS))
        held.sort()
    sizes = [r.size for r in held]
    cuts = balanced_cuts(sizes, shards, least_capacity(sizes, shards))
    return [held[c].low if c < len(held) else None for c in cuts]


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``size``, ``text_crc32``, ``shard`` from 0 and ``slot``, gapless from 0 in a shard.

    Equal texts share a shard, null and empty text among them. The largest shard is as small as contiguous cuts between
    groups allow, and the others share what is left evenly. Repeated rows keep a slot each. An empty table gives no rows.
    A slot follows a hash of the id, so no task has to order a whole shard.
    """
    rows = durable(sized(docs))
    groups = durable(rows.groupBy("place").agg(F.sum("size").alias("size")))
    reached = [(F.col("place") >= F.lit(c)).cast("int") for c in cut_places(groups, shards) if c is not None]
    parts = shuffle_partitions(docs)
    placed = rows.withColumn("shard", reduce(operator.add, reached, F.lit(0))).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "place"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begun"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "place")
    # one row per shard and shuffle partition: shards * spark.sql.shuffle.partitions rows at most
    return placed.withColumn("row", F.row_number().over(order)).join(F.broadcast(begun), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("begun") + F.col("row") - 1).cast("long").alias("slot"))


def digest(result: DataFrame) -> DataFrame:
    """The law by which rows were placed beside the result; ``grown_shard`` belongs to another law and is null."""
    return result.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
