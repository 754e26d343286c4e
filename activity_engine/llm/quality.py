"""Hierarchical empirical Bayes for junk and toxic documents: evidence of the text, and posteriors of its site and path.

* Evidence: log odds of *marks* (a word, its first four and its first five bytes, its last three bytes where these are
  no letters) between labelled documents that have a label and those that have not, less one standard error; and a few
  rates of the text (repeated words, capitals, marks without letters). A logistic fit turns them into a probability.
  Marks and fit come from at most about ``FIT_ROWS`` labelled rows, taken by a hash of their id; everything else is done
  over all documents.
* Sites (``source``) and paths in them (``source``, ``lang``): the mean probability of their documents, by grouped sums
  over the corpus, shrunk toward the level above as if ``STRENGTH`` documents of that level had been seen as well.
* A document's posterior adds to its own log odds what its path's log odds exceed those of the whole corpus by.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_engine.llm.words import Words, _ranges, cut, mix, signed, slices
from activity_engine.session import durable

FIT_ROWS = 60_000
STRENGTH = 200.0
#: The most telling marks kept for a label; this bounds what tasks are sent.
MARKS = 20_000
#: Labelled documents of a kind that must have a mark, and the least log odds for it to count.
MIN_DOCS = 5
MIN_ODDS = 2.0
LABELS = ("junk", "toxic")
_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"): ord("Z") + 1] = True


def marks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(mark, document row), each pair once."""
    lower = words.data | np.where(_UPPER[words.data], 32, 0).astype(np.uint8)
    symbols = mix(lower.astype(_U) + _U(1))
    ends = words.ends
    plain = ends - (words.ends - words.starts > 1) * ~_LETTER[words.data[ends - 1]] if len(ends) else ends
    kinds = [_ranges(symbols, words.starts, plain, "byte")]
    for size in (4, 5):
        kinds.append(mix(_ranges(symbols, words.starts, np.minimum(words.starts + size, plain), "byte") ^ _U(size)))
    tail = np.maximum(words.starts, ends - 3)
    odd = ~_LETTER[words.data[np.maximum(ends - 2, words.starts)]] if len(ends) else np.zeros(0, bool)
    found = np.concatenate([*kinds, mix(_ranges(symbols, tail, ends, "byte")[odd] ^ _U(99))])
    rows = np.concatenate([words.doc] * 3 + [words.doc[odd]]).astype(np.int64)
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    new = np.r_[True, (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])][:len(found)]
    return found[new], rows[new]


def rates(words: Words) -> np.ndarray:
    """Per text: share of words equal to the one before, of words without small letters, of words whose end is no letter,
    of words without any letter, and of distinct words; zeros for a text without words."""
    n = np.diff(words.first)
    safe = np.maximum(n, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc, flag, len(n)) / safe

    def within(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[words.ends] - total[words.starts]

    same = np.zeros(len(words.hashes), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    letters, capitals = within(_LETTER[words.data]), within(_UPPER[words.data])
    size = words.ends - words.starts
    loud = (capitals > 1) & (2 * capitals >= letters)
    odd = (size > 2) & ~_LETTER[words.data[words.ends - 1]] & ~_LETTER[words.data[words.ends - 2]] if len(size) else same
    order = np.lexsort((words.hashes, words.doc))
    h, d = words.hashes[order], words.doc[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])][:len(h)]
    distinct = np.bincount(d[fresh], minlength=len(n)) / safe
    return np.stack([share(same), share(loud), share(odd), share(letters == 0), np.where(n > 20, distinct, 1.0)], axis=1)


@dataclass
class Evidence:
    """What was learned for one label: marks with their log odds, sorted by mark, and the weights of the fit."""

    names: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray | None = None
    prior: float = 0.0

    def features(self, found: np.ndarray, rows: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Per text: 1, its strongest mark, the root of its number of marks, the sum of its marks (bounded), its rates."""
        n = len(shares)
        top, count, total = np.zeros(n), np.zeros(n), np.zeros(n)
        if len(self.names) and len(found):
            place = np.minimum(np.searchsorted(self.names, found), len(self.names) - 1)
            hit = self.names[place] == found
            np.maximum.at(top, rows[hit], self.odds[place[hit]])
            count += np.bincount(rows[hit], minlength=n)
            total += np.bincount(rows[hit], self.odds[place[hit]], minlength=n)
        return np.column_stack([np.ones(n), top, np.sqrt(count), np.minimum(total, 50) / 10, shares])

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.prior)
        return np.clip(features @ self.weights, -30, 30)


def fit(features: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps; the ridge keeps them finite where the labels separate."""
    weights = np.zeros(features.shape[1])
    penalty = ridge * np.eye(features.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (label - p) - penalty @ weights
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + penalty, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _mark_counts(batches):
    """(mark, documents, junk, toxic) summed over each batch."""
    for batch in batches:
        label = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in LABELS])
        found, counts, at = [], [], 0
        for part, texts in slices(batch):
            name, row = marks(cut(texts))
            found.append(name)
            counts.append(np.r_[np.ones((1, len(row)), np.int64), label[:, at + row]])
            at += part.num_rows
        name = np.concatenate(found) if found else np.zeros(0, _U)
        count = np.concatenate(counts, axis=1) if counts else np.zeros((3, 0), np.int64)
        order = np.argsort(name, kind="stable")
        name, count = name[order], count[:, order]
        new = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.zeros(0, np.int64)
        sums = np.add.reduceat(count, new, axis=1) if len(new) else count
        yield pa.RecordBatch.from_arrays([pa.array(signed(name[new])), *[pa.array(s) for s in sums]], names=["mark", "docs", *LABELS])


def _fit_features(evidence: dict[str, Evidence]):
    def run(batches):
        for batch in batches:
            columns = []
            for part, texts in slices(batch):
                words = cut(texts)
                found, shares = marks(words), rates(words)
                columns.append(pa.record_batch(
                    {name: pa.array(list(evidence[name].features(*found, shares)), pa.list_(pa.float64())) for name in LABELS}))
            at = 0
            for part in columns:
                mine = batch.slice(at, part.num_rows)
                at += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(2)], *[mine.column(n).cast(pa.int64()) for n in LABELS]],
                    names=["f_junk", "f_toxic", *LABELS])

    return run


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict[str, Evidence]:
    """Evidence for each label. ``labels``: (doc_id, quality, toxic), 0 or 1; null says nothing and counts as no label.

    Of an id that is labelled repeatedly the worst label holds. At most about ``rows`` ids are used, by hash of the id.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 0).cast("int")).alias("junk"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = durable(known.select("doc_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in LABELS]))
    total = known.count()
    share = 1.0 if total <= rows else rows / total
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # the sample has about ``rows`` rows of three numbers, whatever the tables hold
    labelled = texts.join(F.broadcast(sample), "doc_id").drop("doc_id")
    counts = durable(labelled.mapInArrow(_mark_counts, "mark long, docs long, junk long, toxic long")
                     .groupBy("mark").agg(*[F.sum(c).alias(c) for c in ("docs", *LABELS)])
                     .where(f"junk >= {MIN_DOCS} or toxic >= {MIN_DOCS}"))
    totals = labelled.agg(F.count("*").alias("docs"), *[F.sum(c).alias(c) for c in LABELS]).first()
    evidence = {}
    for name in LABELS:
        have, rest = totals[name] or 0, (totals["docs"] or 0) - (totals[name] or 0)
        evidence[name] = Evidence(prior=float(np.log((have + 0.5) / (rest + 0.5))) if have + rest else -30.0)
        if have and rest:
            mine, other = F.col(name) + 0.5, F.col("docs") - F.col(name) + 0.5
            odds = F.log(mine / (have + 1)) - F.log(other / (rest + 1)) - F.sqrt(1 / mine + 1 / other)
            best = (counts.where(F.col(name) >= MIN_DOCS).select("mark", odds.alias("odds")).where(F.col("odds") >= MIN_ODDS)
                    .orderBy(F.desc("odds"), "mark").limit(MARKS).collect())
            names = np.array([r.mark for r in best], np.int64).view(_U)
            order = np.argsort(names)
            evidence[name].names, evidence[name].odds = names[order], np.array([r.odds for r in best])[order]
    made = labelled.mapInArrow(_fit_features(evidence), "f_junk array<double>, f_toxic array<double>, junk long, toxic long").collect()
    for name in LABELS:
        label = np.array([r[name] for r in made], float)
        if 0 < label.sum() < len(label):
            evidence[name].weights = fit(np.array([r[f"f_{name}"] for r in made]), label)
    return evidence


def _scorer(evidence: dict[str, Evidence]):
    @F.arrow_udf("struct<junk: double, toxic: double>")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [np.zeros((2, 0))]
        for _, slice_ in slices(pa.record_batch({"text": texts})):
            words = cut(slice_)
            found, shares = marks(words), rates(words)
            parts.append(np.stack([evidence[n].log_odds(evidence[n].features(*found, shares)) for n in LABELS]))
        made = np.concatenate(parts, axis=1)
        return pa.StructArray.from_arrays([pa.array(made[0]), pa.array(made[1])], names=list(LABELS))

    return scored


def _probability(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _posteriors(scores: DataFrame) -> DataFrame:
    """(site, path, pages, and for each label the shift): one row per path, from (site, path, junk, toxic) log odds."""
    sums = [F.sum(_probability(F.col(n))).alias(n) for n in LABELS]
    paths = durable(scores.groupBy("site", "path").agg(F.count("*").alias("pages"), *sums))
    site_sums = paths.groupBy("site").agg(F.sum("pages").alias("site_pages"), *[F.sum(n).alias(f"site_{n}") for n in LABELS])
    whole = paths.agg(F.sum("pages").alias("pages"), *[F.sum(n).alias(n) for n in LABELS]).first()
    joined = paths.join(site_sums, paths["site"].eqNullSafe(site_sums["site"])).drop(site_sums["site"])
    for name in LABELS:
        world = ((whole[name] or 0) + 0.5) / ((whole["pages"] or 0) + 1)
        site = (F.col(f"site_{name}") + STRENGTH * world) / (F.col("site_pages") + STRENGTH)
        path = (F.col(name) + STRENGTH * site) / (F.col("pages") + STRENGTH)
        joined = joined.withColumn(f"{name}_rate", path).withColumn(
            f"{name}_shift", _log_odds(path) - float(np.log(world / (1 - world))))
    return durable(joined.select("site", "path", *[f"{n}_{k}" for n in LABELS for k in ("rate", "shift")]))


def judge(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with all its columns and ``__junk``, ``__toxic`` (posterior probabilities), ``__junk_rate``, ``__toxic_rate``
    (of its path) and ``__keep`` (both posteriors under a half).

    Null and empty texts have no marks. Rows without source or lang form a site or path of their own. Without labels of
    both kinds nothing is known of a label and its prior holds. Columns of the input that are named like a new one are replaced. Repeated rows count as documents of their own.
    """
    evidence = learn(docs, labels, rows)
    score = _scorer(evidence)(F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")))
    # the row travels as one value, so none of its columns can clash
    known = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("own_site"),
                        F.col("lang").cast("string").alias("own_path"), score.alias("score"))
    level = _posteriors(known.select(F.col("own_site").alias("site"), F.col("own_path").alias("path"), "score.junk", "score.toxic"))
    # one row per path; Spark broadcasts them while they are small and else splits large sites
    both = known.join(level, F.col("own_site").eqNullSafe(F.col("site")) & F.col("own_path").eqNullSafe(F.col("path")), "left")
    posterior = {n: _probability(F.col(f"score.{n}") + F.col(f"{n}_shift")) for n in LABELS}
    made = {f"__{n}": posterior[n] for n in LABELS} | {f"__{n}_rate": F.col(f"{n}_rate") for n in LABELS}
    done = both.select("row", *[made[n].alias(n) for n in made])
    out = done.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in made and c != "__keep"], *made)
    return out.withColumn("__keep", (F.col("__junk") < 0.5) & (F.col("__toxic") < 0.5))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.col("__junk").alias("p_junk"), F.col("__toxic").alias("p_toxic"),
                         F.col("__junk_rate").alias("junk_rate"), F.col("__toxic_rate").alias("toxic_rate"), F.col("__keep").alias("keep"))
