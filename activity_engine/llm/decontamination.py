"""Find benchmark items in documents, edited or not: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK walk reads words from a start: at step t it emits the word it stands on and moves on if bit t of that word's hash
is set. Words are random bits, so sequences at a small edit distance emit mostly the same words at the same steps: edit
distance becomes Hamming distance. A table samples a few steps and hashes what was emitted there; ``TABLES`` of them over
``WALKS`` independent walks give near copies many chances to collide.

Windows of documents start at every ``STRIDE``-th word of a text, windows of an item at each of its first words, so an
exact passage always has an aligned window. A window is about as long as the shortest item of its class; classes double.
Every collision is settled by the edit distance (in words) between the item and the best stretch of the document there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.llm.words import Words, cut, give_back, ids, mix, slices

#: An item counts as found if at most this share of its words is edited.
MAX_EDITS = 0.2
STRIDE = 4
WALKS = 2
TABLES = 8
SAMPLED = 5
#: Items that are looked for in one pass; more take further passes over the documents.
ITEMS = 20_000
#: Texts are looked through in slices of about so many bytes.
AT_ONCE = 1 << 19
_U = np.uint64
#: At most so many bits of a key are looked up in a table's filter first.
_FILTER_BITS = 20


def least_words(words: int) -> tuple[int, int]:
    """Window length for an item of so many words, and how many starts of it are looked up at least."""
    if words < 8:
        return words, 1
    size = 8
    while size * 2 <= words:
        size *= 2
    return size - STRIDE + 1, STRIDE


def edit_place(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the stretch of ``text`` nearest to ``item``, the first of the best, or None beyond ``most``."""
    n = len(text)
    best = np.zeros(n + 1, np.int64)
    begun = np.arange(n + 1)
    steps = np.arange(n + 1)
    for word in item:
        change = best[:-1] + (text != word)
        drop = best + 1
        row, start = drop.copy(), begun.copy()
        better = change <= row[1:]
        row[1:][better], start[1:][better] = change[better], begun[:-1][better]
        # insertions along the row: cost of coming from place j is row[j] + (i - j)
        ahead = np.minimum.accumulate(row - steps)
        source = np.maximum.accumulate(np.where(row - steps == ahead, steps, 0))
        best, begun = ahead + steps, start[source]
    stop = int(np.argmin(best))
    return (int(best[stop]), int(begun[stop]), stop) if best[stop] <= most else None


@dataclass
class Walk:
    """One random walk: its samples per table, and the hash of what they saw."""

    seed: int
    steps: int

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng([self.seed, self.steps])
        places = np.sort([random.choice(self.steps, min(SAMPLED, self.steps), replace=False) for _ in range(TABLES)], axis=1)
        return places, random.integers(1, 1 << 64, places.shape, _U, endpoint=False) | _U(1)


def embed(hashes: np.ndarray, starts: np.ndarray, sizes: list[int], seed: int) -> dict[int, np.ndarray]:
    """For each window size, a (TABLES, starts) array of table keys of the walks from ``starts``. Past the end is word 0."""
    lengths = {size: max(1, size + size // 2) if size >= 4 else 1 for size in sizes}
    walks = {size: Walk(seed, lengths[size]).samples() for size in sizes}
    keys = {size: np.zeros((TABLES, len(starts)), _U) for size in sizes}
    longest = max(lengths.values(), default=0)
    padded = np.r_[hashes, np.zeros(longest + 1, _U)]
    moves = mix(padded ^ _U(0x632BE59BD9B4E019 * (seed + 1) % (1 << 64)))
    at = starts.copy()
    for step in range(longest):
        seen = padded[at]
        for size, (places, factors) in walks.items():
            for table, k in zip(*np.nonzero(places == step)):
                keys[size][table] += seen * factors[table, k]
        at += ((moves[at] >> _U(step % 64)) & _U(1)).astype(np.int64)
    return keys


def _filter(keys: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """How far to shift a key, and whether any of ``keys`` is left as that number; some 64 numbers for every key."""
    shift = _U(64 - min(_FILTER_BITS, 6 + len(keys).bit_length()))
    bits = np.zeros(1 << (64 - int(shift)), bool)
    bits[keys >> shift] = True
    return shift, bits


class Items:
    """Benchmark items ready for look-up: their words, and for each walk and window size the sorted keys of every table."""

    def __init__(self, names: np.ndarray, texts: pa.Array):
        words = cut(texts, lower=True)
        self.names = names
        self.words = [words.hashes[a:e] for a, e in zip(words.first[:-1], words.first[1:])]
        plan = [(i, *least_words(len(w))) for i, w in enumerate(self.words) if len(w)]
        self.sizes = sorted({size for _, size, _ in plan})
        self.tables = []
        for seed in range(WALKS):
            for size in self.sizes:
                mine = [i for i, s, _ in plan if s == size]
                found: list[list] = [[], [], []]
                for i in mine:
                    offsets = np.arange(max(STRIDE, len(self.words[i]) - size + 1) if len(self.words[i]) >= 8 else 1)
                    found[0].append(embed(self.words[i], offsets, [size], seed)[size])
                    found[1].append(np.full(len(offsets), i))
                    found[2].append(offsets)
                keys, item, offset = np.concatenate(found[0], axis=1), np.concatenate(found[1]), np.concatenate(found[2])
                for table in range(TABLES):
                    key = mix(keys[table])
                    order = np.argsort(key)
                    self.tables.append((seed, size, table, key[order], item[order], offset[order]))
        self.filters = [_filter(key) for *_, key, _, _ in self.tables]

    def __getstate__(self) -> dict:
        """Filters do not travel: a task makes its own from the keys."""
        return {k: v for k, v in self.__dict__.items() if k != "filters"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, filters=[_filter(key) for *_, key, _, _ in state["tables"]])

    def candidates(self, words: Words) -> np.ndarray:
        """Distinct (document row, item, place where the item would begin) of windows that collide in some table."""
        place = np.arange(len(words.hashes)) - words.first[words.doc]
        short = any(len(w) < 8 for w in self.words)
        starts = np.flatnonzero(place % (1 if short else STRIDE) == 0)
        found = []
        if len(starts):
            for seed in range(WALKS):
                keys = embed(words.hashes, starts, self.sizes, seed)
                for (walk, size, table, key, item, offset), (shift, bits) in zip(self.tables, self.filters):
                    if walk == seed:
                        mine = mix(keys[size][table])
                        maybe = np.flatnonzero(bits[mine >> shift])
                        low, high = (np.searchsorted(key, mine[maybe], side) for side in ("left", "right"))
                        count = high - low
                        which = np.repeat(maybe, count)
                        entry = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                        found.append(np.stack([words.doc[starts[which]], item[entry], starts[which] - offset[entry]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def _matches(items: Items, max_edits: float):
    def settled(words: Words, doc_ids: np.ndarray):
        done: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for doc, item, begin in items.candidates(words).tolist():
            seek = items.words[item]
            most = int(max_edits * len(seek))
            a, e = int(words.first[doc]), int(words.first[doc + 1])
            seen = done.setdefault((doc, item), [])
            if any(low <= begin < high for low, high in seen):
                continue
            low, high = max(a, begin - most), min(e, begin + len(seek) + most)
            seen.append((begin - most, begin + most + 1))
            hit = edit_place(seek, words.hashes[low:high], most)
            if hit:
                yield doc_ids[doc], items.names[item], low - a + hit[1], low - a + hit[2], hit[0], len(seek)

    def run(batches):
        for batch in batches:
            rows = [row for part, texts in slices(batch, AT_ONCE) for row in settled(cut(texts, lower=True), ids(part.column("doc_id")))]
            columns = list(zip(*rows)) if rows else [[]] * 6
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["doc_id", "item_id", "start", "stop", "edits", "item_words"])

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """(doc_id, item_id, start, stop, edits, item_words): for each document and item, its nearest passage, in words.

    Words are compared without regard to the case of A-Z. An item is found where at most ``max_edits`` of its words are
    inserted, dropped or changed; items of fewer than five words must match exactly. Null and empty texts and items, and
    items or documents without an id, match nothing. Repeated items with one id count as one. Ties go to the first passage.
    """
    items = (benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
        .where(F.length("text") > 0).distinct())
    total = items.count()
    found = None
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    passes = max(1, -(-total // ITEMS))
    for k in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        held = Items(np.array([r.item_id for r in rows], np.int64), pa.array([bytes(r.text) for r in rows], pa.binary()))
        part = texts.mapInArrow(_matches(held, max_edits), "doc_id long, item_id long, start long, stop long, edits long, item_words long")
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct("edits", "start", "stop", "item_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.start", "best.stop", "best.edits", "best.item_words")
