"""Remove passages that an earlier document already holds, found with automata of recurring phrases.

1. Of every window of ``window`` words the phrase (half a window long) with the least hash is taken. Equal windows take
   equal phrases, so a passage that recurs leaves at least one phrase that recurs; few phrases are taken for many windows.
2. Phrases that a smaller id holds too are *confirmed* by a grouped minimum.
3. Every block of documents gets the confirmed phrases that it holds, compiles them into an Aho-Corasick automaton (one
   shard per block, no larger than the block) and streams its documents through, which locates every occurrence.
   Windows around the occurrences are the only ones that can recur; the least id of each is found by a grouped minimum.
4. Each document drops the words of all windows whose least id is smaller than its own.

No task sees more than one block of documents, and a key has at most one row per block in any shuffle.
"""

from __future__ import annotations

from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.llm import blocks
from activity_engine.llm.words import Words, cut, ids, least_of, signed, slices

KEYS = "block int, key long, lo long, hi long"
_KEYS = pa.schema([("block", pa.int32()), ("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
RESULT = "doc_id long, n_words long, spans array<struct<start: long, stop: long>>, kept string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.string())])
#: Code points that stand for words in the automata; surrogates are skipped.
_SYMBOLS = 0x10FFFF - 0x800
_NONE = np.uint64(np.iinfo(np.uint64).max)


def _per_key(block: int, keys: list[np.ndarray], docs: list[np.ndarray]) -> pa.Table:
    """One row per key with its least and largest id."""
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    columns = [np.full(len(new), block, np.int32), signed(key[new])]
    columns += [f.reduceat(doc, new) if len(new) else doc for f in (np.minimum, np.maximum)]
    return pa.table([pa.array(c) for c in columns], schema=_KEYS)


def _block(table: pa.Table) -> int:
    return table.column("block")[0].as_py() if table.num_rows else 0


def _phrases(window: int, phrase: int):
    def run(docs: pa.Table) -> pa.Table:
        keys, owners = [], []
        for part, texts in slices(docs):
            words = cut(texts)
            inside = words.inside(window)
            if inside.any():
                taken = least_of(words.grams(phrase), window - phrase + 1)[inside]
                doc = words.doc[:len(inside)][inside]
                new = np.r_[True, (taken[1:] != taken[:-1]) | (doc[1:] != doc[:-1])]
                keys.append(taken[new])
                owners.append(ids(part.column("doc_id"))[doc[new]])
        return _per_key(_block(docs), keys, owners)

    return run


class PhraseAutomaton:
    """Automaton over word sequences: each word that a phrase holds is one letter, all other words are letter 0."""

    def __init__(self, phrases: list[np.ndarray]):
        """``phrases``: word hashes of each phrase; a phrase's number is its place in the list."""
        self.letters = np.unique(np.concatenate(phrases)) if phrases else np.zeros(0, np.uint64)
        self.automaton = ahocorasick.Automaton()
        for number, phrase in enumerate(phrases):
            self.automaton.add_word(self._spelled(phrase), number)
        if phrases:
            self.automaton.make_automaton()

    def _spelled(self, hashes: np.ndarray) -> str:
        place = np.searchsorted(self.letters, hashes)
        place[place == len(self.letters)] = 0
        letter = np.where(self.letters[place] == hashes, 1 + place % (_SYMBOLS - 1), 0).astype(np.uint32)
        return (letter + np.where(letter >= 0xD800, 0x800, 0).astype(np.uint32)).tobytes().decode("utf-32-le")

    def occurrences(self, hashes: np.ndarray) -> np.ndarray:
        """(place of the last word, number) of every occurrence of every phrase."""
        if not len(self.letters) or not len(hashes):
            return np.zeros((0, 2), np.int64)
        return np.array(list(self.automaton.iter(self._spelled(hashes))), np.int64).reshape(-1, 2)


def _windows(window: int, phrase: int):
    def located(words: Words, automaton: PhraseAutomaton, names: np.ndarray) -> np.ndarray:
        """Whether each window holds, as its least phrase, one that the automaton located."""
        grams = words.grams(phrase)
        last, number = automaton.occurrences(words.hashes).T
        place = last - phrase + 1
        right = grams[place] == names[number]
        there = np.full(len(grams), _NONE)
        there[place[right]] = grams[place[right]]
        width = window - phrase + 1
        return words.inside(window) & (least_of(there, width) == least_of(grams, width)) & (least_of(there, width) != _NONE)

    def run(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        wanted = np.sort(confirmed.column("key").to_numpy().view(np.uint64))
        if not len(wanted) or not docs.num_rows:
            return _per_key(0, [], [])
        held = [(ids(part.column("doc_id")), cut(texts)) for part, texts in slices(docs)]
        names, phrases, known = [], [], np.zeros(0, np.uint64)
        for _, words in held:
            grams = words.grams(phrase)
            inside = words.inside(phrase)
            found, place = np.unique(grams[inside], return_index=True)
            place = np.flatnonzero(inside)[place]
            new = np.isin(found, wanted, assume_unique=True) & ~np.isin(found, known, assume_unique=True)
            names.append(found[new])
            phrases += [words.hashes[p: p + phrase] for p in place[new]]
            known = np.concatenate([known, found[new]])
        automaton, name = PhraseAutomaton(phrases), np.concatenate(names)
        keys, owners = [], []
        for doc_ids, words in held:
            if len(words.hashes) >= window:
                candidate = located(words, automaton, name)
                keys.append(words.grams(window, "other")[candidate])
                owners.append(doc_ids[words.doc[:len(candidate)][candidate]])
        return _per_key(_block(docs), keys, owners)

    return run


def _removal(window: int):
    def run(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        key = repeated.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        key, owner = key[order], repeated.column("owner").to_numpy()[order]
        out = []
        for part, texts in slices(docs):
            words, doc_ids = cut(texts), ids(part.column("doc_id"))
            edge = np.zeros(len(words.hashes) + 1, np.int64)
            if len(key) and len(words.hashes) >= window:
                grams = words.grams(window, "other")
                place = np.minimum(np.searchsorted(key, grams), len(key) - 1)
                gone = words.inside(window) & (key[place] == grams)
                gone &= owner[place] < doc_ids[words.doc[:len(gone)]]
                edge[:len(gone)] += gone
                edge[window: window + len(gone)] -= gone
            covered = np.cumsum(edge[:-1]) > 0
            fresh = np.r_[True, words.doc[1:] != words.doc[:-1]][:len(covered)]
            start = np.flatnonzero(covered & (fresh | ~np.r_[False, covered[:-1]][:len(covered)]))
            stop = np.flatnonzero(covered & (np.r_[fresh[1:], True][:len(covered)] | ~np.r_[covered[1:], False][:len(covered)])) + 1
            base = words.first[words.doc[start]]
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(start, words.first).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(start - base), pa.array(stop - base)], fields=list(_SPAN)))
            kept = []
            for i, text in enumerate(texts.to_pylist()):
                mine = covered[words.first[i]: words.first[i + 1]]
                pieces = text.split()
                kept.append(b" ".join(compress(pieces, ~mine) if mine.any() else pieces))
            out.append(pa.table([
                part.column("doc_id").cast(pa.int64()), pa.array(np.diff(words.first).astype(np.int64)), spans,
                pa.array(kept, pa.binary()).cast(pa.string())], schema=_RESULT))
        return pa.concat_tables(out) if out else _RESULT.empty_table()

    return run


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, removed word ``spans`` [start, stop) and the ``kept`` words.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id. Null and
    empty texts have no words. A null id counts as larger than any other: such a row loses repeats but owns none. Rows
    with one id never remove each other's words, nor does a document its own. Other columns of ``docs`` are not read.
    """
    phrase = max(1, window // 2)
    texts = blocks.dealt(docs)
    by_block = lambda df: df.groupBy("block")
    taken = by_block(texts).applyInArrow(_phrases(window, phrase), KEYS)
    located = by_block(texts).cogroup(by_block(blocks.recurring(taken))).applyInArrow(_windows(window, phrase), KEYS)
    return by_block(texts).cogroup(by_block(blocks.repeated(located))).applyInArrow(_removal(window), RESULT)


def digest(result: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and the SHA-256 of the kept words."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return result.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
