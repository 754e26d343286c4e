"""Title lookups: anchors contained in titles, and exact / substring / fuzzy search."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from activity_engine.session import durable, small

#: Characters of the pieces by which anchors are looked up.
PIECE = 3
#: Anchors that are handed to the tasks, so that the pieces of titles stay where they are; more are joined by key.
FEW_ANCHORS = 100_000


def _pieces(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda p: F.substr(text, p, F.lit(size))))


def anchor_candidates(items: DataFrame, title: str, anchors: DataFrame, anchor: str) -> DataFrame:
    """Items with every anchor whose rarest piece their title has (short anchors: with every one it holds).

    Titles are cut into pieces of one size, however many lengths anchors have. An anchor is found by that piece of its
    own which the fewest titles have; one with a piece that no title has is found by none. Anchors shorter than a piece
    are looked up among all pieces of their length. Only anchors are ever broadcast: the pieces of titles are many, however
    little room equal ones take in a compressed shuffle.
    """
    known = durable(anchors.select(F.col(anchor)).filter(F.length(anchor) > 0).distinct())
    rows = durable(items)
    found = None
    cut = rows.filter(F.length(title) >= PIECE).withColumn("_piece", F.explode(_pieces(F.col(title), PIECE)))
    often = cut.groupBy("_piece").agg(F.count("*").alias("_titles"))
    own = known.filter(F.length(anchor) >= PIECE).withColumn("_piece", F.explode(_pieces(F.col(anchor), PIECE)))
    told = own.join(often.hint("merge"), "_piece", "left").groupBy(anchor).agg(
        F.min_by(F.struct("_piece", "_titles"), F.struct(F.coalesce("_titles", F.lit(0)), F.col("_piece"))).alias("_rare"))
    index = small(told.filter("_rare._titles > 0").select(anchor, "_rare._piece"), FEW_ANCHORS)
    found = cut.join(index, "_piece").drop("_piece")
    for size in range(1, PIECE):
        short = small(known.filter(F.length(anchor) == size), FEW_ANCHORS)
        found = found.unionByName(rows.withColumn(anchor, F.explode(_pieces(F.col(title), size))).join(short, anchor))
    return found


def contained_anchors(items: DataFrame, title: str, anchors: DataFrame, anchor: str) -> DataFrame:
    """Items joined with every anchor that is a substring of their title."""
    return anchor_candidates(items, title, anchors, anchor).filter(F.contains(F.col(title), F.col(anchor)))


def longest_block(a: str, b: str) -> tuple[int, int, int]:
    """(size, place in a, place in b) of the longest common substring; the first in ``a``, then in ``b``, of equal ones."""
    best, before = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        here = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                size = here[j + 1] = before[j] + 1
                if size > best[0]:
                    best = (size, i - size + 1, j - size + 1)
        before = here
    return best


def matching_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over all characters: the longest common block, then the same to its left and
    right. 1 for equal texts, two empty ones among them."""
    total, matched, open_ = len(a) + len(b), 0, [(a, b)]
    while open_:
        a, b = open_.pop()
        size, i, j = longest_block(a, b)
        if size:
            matched += size
            open_ += [(a[:i], b[:j]), (a[i + size:], b[j + size:])]
    return 2 * matched / total if total else 1.0


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else matching_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_bound(wanted: str, title: Column) -> Column:
    """No matching ratio is above twice the characters that both texts have, as often as both have them, over all characters."""
    if not wanted:
        return F.when(F.length(title) == 0, 1.0).otherwise(0.0)
    both = sum((F.least(F.length(title) - F.length(F.replace(title, F.lit(c), F.lit(""))), F.lit(n)) for c, n in sorted(Counter(wanted).items())), F.lit(0))
    return 2.0 * both / (F.length(title) + len(wanted))


def find_titles(titles: DataFrame, title: str, score: str, wanted: Sequence[str], threshold: float = 0.55) -> DataFrame:
    """Best title for each wanted text: exact match, else the best scored title holding it, else the most similar by matching blocks.

    One pass over the titles; every title is bounded against the list of wanted texts in place, and only those that can
    reach the threshold, of texts that no title equals or holds, are compared block by block. A blank text finds nothing.
    """
    lowered = F.lower(F.trim(F.col(title)))
    texts = [w for w in dict.fromkeys(w.strip().lower() for w in wanted) if w]
    if not texts:
        return titles.select(F.lit("").alias("wanted"), title, F.lit(0).alias("level")).where("false")
    rated = titles.select(title, score, F.explode(F.array(*[
        F.struct(F.lit(w).alias("wanted"), ratio_bound(w, lowered).alias("bound")) for w in texts])).alias("_w"))
    level = F.when(lowered == F.col("_w.wanted"), 1).when(lowered.contains(F.col("_w.wanted")), 2).when(F.col("_w.bound") >= threshold, 3)
    rated = durable(rated.select(title, score, "_w.wanted", level.alias("level")).filter(F.col("level").isNotNull()))
    direct = rated.filter("level < 3").groupBy("wanted").agg(F.min_by(F.struct(title, "level"), F.struct(
        F.col("level"), -F.col(score).cast("double"), F.col(title))).alias("_b"))
    # at most a row for each wanted text
    rest = rated.filter("level = 3").join(F.broadcast(direct.select("wanted")), "wanted", "left_anti")
    alike = rest.withColumn("_similar", _ratio(F.col("wanted"), lowered)).filter(F.col("_similar") >= threshold)
    fuzzy = alike.groupBy("wanted").agg(F.min_by(F.struct(title, "level"), F.struct(-F.col("_similar"), F.col(title))).alias("_b"))
    return direct.unionByName(fuzzy).select("wanted", f"_b.{title}", "_b.level")
