"""Exact join of documents whose word n-gram sets have a Jaccard similarity of ``percent`` / 100 or more.

Every set is put in one global order: by hash, with the very frequent n-grams last. Two similar sets share an n-gram
among the first few of each (the *prefix*), so only n-grams that stand in the prefixes of two sets lead anywhere.

1. ``frequent``: n-grams that make up more than 2**-22 of all, at most 2**22 of them, found by counting.
2. Per block of documents the sets are made; a grouped minimum tells each block which of its prefix n-grams, and which
   whole sets, other documents have too. One document stands for all with the same set.
3. Each set meets the least set of the groups in which it has most prefix n-grams in common; after that, groups are only
   searched for pairs that are not connected yet, that are alike enough in length, that share enough of their prefixes, and
   whose *marks* do not tell them apart. A set's marks are bits, each flipped once for every n-gram that falls on it: two
   sets differ in at least as many n-grams as in marks, so a pair whose marks differ too often cannot be similar.
4. Pairs are verified around one of the two: its partners' ordered sets form a prefix tree, which is walked with the
   overlap so far; equal beginnings are compared once, and a subtree is left when the remaining lengths cannot suffice.

A connected pair needs no further link to give the same components, which spares large groups of copies the square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from activity_engine.llm import blocks
from activity_engine.llm.components import components
from activity_engine.llm.words import cut, ids, mix, signed, slices
from activity_engine.session import durable

N = 5
PERCENT = 80
#: An n-gram is frequent if it makes up more than this share of all; that bounds their number.
FREQUENT = 1 / (1 << 22)
#: Partners of one document that are verified in one task.
FAN = 256
#: 64-bit words of a set's marks.
MARKS = 8
_U = np.uint64


def sets_of(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct word n-grams; a text of fewer words has one, of all its words."""
    words = cut(texts, lower=True)
    grams = words.grams(n)
    out = []
    for a, e in zip(words.first[:-1], words.first[1:]):
        if e - a >= n:
            out.append(np.unique(grams[a: e - n + 1]))
        elif e > a:  # the number of words keeps short texts apart from n-grams
            powers = _U(0xD1342543DE82EF95) ** np.arange(1, e - a + 1, dtype=_U)
            out.append(mix(np.array([(words.hashes[a:e] * powers).sum() + _U(e - a)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def needed(a, b, percent: int = PERCENT):
    """Least overlap of sets of sizes ``a`` and ``b`` at the similarity: 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size, percent: int = PERCENT):
    """How many of a set's first n-grams must hold one of any similar set's."""
    return size - (-(-percent * size // 100)) + (size > 0)


def ordered(held: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: frequent n-grams last."""
    if not len(frequent):
        return held
    late = frequent[np.minimum(np.searchsorted(frequent, held), len(frequent) - 1)] == held
    return np.concatenate([held[~late], held[late]])


def _local_counts(n: int):
    """n-grams that occur several times in one batch, and at key 0 the number of all."""
    def run(batches):
        for batch in batches:
            found = []
            for _, texts in slices(batch):
                words = cut(texts, lower=True)
                found.append(words.grams(n)[words.inside(n)])
            every = np.concatenate(found) if found else np.zeros(0, _U)
            del found
            every.sort()
            new = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
            count = np.diff(np.r_[new, len(every)])
            often = count >= 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[0, signed(every[new][often])]), pa.array(np.r_[len(every), count[often]])], names=["key", "n"])

    return run


def frequent(docs: DataFrame, n: int = N) -> np.ndarray:
    """Sorted hashes of the frequent n-grams: at most 1 / ``FREQUENT`` of them, as each takes that share of the total."""
    counts = durable(docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_local_counts(n), "key long, n long")
                     .groupBy("key").agg(F.sum("n").alias("n")))
    total = counts.where("key = 0").first()
    least = max(32, int((total.n if total else 0) * FREQUENT))
    rows = counts.where((F.col("key") != 0) & (F.col("n") > least)).select("key").collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(_U))


def _opened(table: pa.Table):
    """Slices of the documents of one block."""
    return (part for batch in blocks.opened(table) for part in slices(batch))


def _class_keys(held: np.ndarray) -> list[np.ndarray]:
    """Two names of a whole set, apart from the names of n-grams."""
    size = _U(len(held))
    return [mix(np.array([mix(held ^ _U(seed)).sum() + size], _U) ^ _U(seed)) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]


def _keys(n: int, percent: int, late: np.ndarray):
    """(block, key, lo, hi): names of whole sets with the least and largest id that has them; of prefix n-grams only whether
    the block holds them once (0, 0) or in several documents (0, 1)."""
    def run(docs: pa.Table) -> pa.Table:
        keys, owners, grams = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, _U)]
        for part, texts in _opened(docs):
            for doc, held in zip(ids(part.column("doc_id")), sets_of(texts, n)):
                if len(held):
                    grams.append(ordered(held, late)[:prefix_length(len(held), percent)])
                    keys += _class_keys(held)
                    owners.append(np.full(2, doc))
        key, doc = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        ends = [f.reduceat(doc, new) if len(new) else doc for f in (np.minimum, np.maximum)]
        gram, count = np.unique(np.concatenate(grams), return_counts=True)
        none = np.zeros(len(gram), np.int64)
        block = np.full(len(new) + len(gram), docs.column("block")[0].as_py(), np.int32)
        columns = (block, signed(np.r_[key[new], gram]), np.r_[ends[0], none], np.r_[ends[1], np.minimum(count - 1, 1)])
        return pa.table([pa.array(c) for c in columns], names=["block", "key", "lo", "hi"])

    return run


def _recurring(keys: DataFrame) -> DataFrame:
    """Rows (block, key, owner) of keys that several documents have. A key has a row per block at most."""
    over = Window.partitionBy("key")
    told = keys.withColumn("owner", F.min("lo").over(over)).withColumn("last", F.max("hi").over(over)).withColumn(
        "blocks", F.count("*").over(over))
    return told.where("blocks > 1 or owner < last").select("block", "key", "owner")


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()),
                   ("tokens", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("text", pa.binary())])


def marks(held: np.ndarray) -> np.ndarray:
    """``MARKS`` words of bits: whether an odd number of the set's n-grams falls on each. The low bits of a hash choose it,
    as the high ones give the order."""
    odd = np.bincount((held % _U(64 * MARKS)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _reduced(n: int, percent: int, late: np.ndarray):
    """Every document's size and class; the first of a class also carries its shared prefix n-grams, marks and text."""
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        key = known.column("key").to_numpy().view(_U)
        order = np.argsort(key)
        key, owner = key[order], known.column("owner").to_numpy()[order]

        def look(values: np.ndarray) -> np.ndarray:
            return np.minimum(np.searchsorted(key, values), max(len(key) - 1, 0))

        rows = []
        for part, texts in _opened(docs):
            for i, (doc, held) in enumerate(zip(ids(part.column("doc_id")).tolist(), sets_of(texts, n))):
                first, tokens, bits, text = doc, None, None, None
                if len(held) and len(key):
                    names = [int(owner[p]) if key[p] == name else doc for name in map(lambda k: k[0], _class_keys(held)) for p in [look(name)]]
                    first = names[0] if names[0] == names[1] else doc
                    if first == doc:
                        mine = ordered(held, late)[:prefix_length(len(held), percent)]
                        mine = mine[key[look(mine)] == mine]
                        if len(mine):
                            tokens, bits, text = signed(mine), marks(held), zstandard.compress(texts[i].as_py())
                rows.append((doc, len(held), first, tokens, bits, text))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _SETS)] if rows else _SETS.empty_table().columns, schema=_SETS)

    return run


def _sizes(n: int):
    """The size of every text's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array([len(held) for held in sets_of(texts, n)], pa.int64())], names=["n_shingles"])

    return run


class PrefixTree:
    """Ordered sets as a prefix tree: sets sorted, each hanging where it leaves the one before."""

    def __init__(self, held: list[np.ndarray]):
        self.order = sorted(range(len(held)), key=lambda i: held[i].astype(">u8").tobytes())
        self.sets = [held[i] for i in self.order]
        self.shared = [0]
        for left, right in zip(self.sets, self.sets[1:]):
            m = min(len(left), len(right))
            unlike = np.flatnonzero(left[:m] != right[:m])
            self.shared.append(int(unlike[0]) if len(unlike) else m)

    def similar(self, probe: np.ndarray, percent: int) -> list[int]:
        """Places (in the list given) of the sets similar to ``probe``.

        ``depth`` and ``overlap`` describe the path to the current leaf: how far it was walked, and how many of its
        first n-grams the probe holds at each step. A path shared with the set before is not walked again.
        """
        found, path, place = [], np.zeros(1, np.int64), np.zeros(1, np.int64)
        for leaf, (held, same) in enumerate(zip(self.sets, self.shared)):
            want = needed(len(held), len(probe), percent)
            if want > min(len(held), len(probe)):
                path, place = path[:same + 1], place[:same + 1]
                continue
            path, place = path[:same + 1], place[:same + 1]
            while True:
                depth = len(path) - 1
                least = min(len(held) - depth, len(probe) - int(place[-1]))
                if path[-1] + least < want or depth == len(held):
                    break
                step = held[depth: depth + 256]
                at = np.searchsorted(probe, step)
                hit = probe[np.minimum(at, len(probe) - 1)] == step
                path = np.r_[path, path[-1] + np.cumsum(hit)]
                place = np.r_[place, at + hit]
            if len(path) - 1 == len(held) and path[-1] >= want:
                found.append(self.order[leaf])
        return found


def _verified(n: int, percent: int):
    """Links between the document that a group is named after and its partners, all with their texts."""
    def run(table: pa.Table) -> pa.Table:
        plain = pa.table([table.column("doc_id"), pa.array([zstandard.decompress(t) for t in table.column("text").to_pylist()], pa.binary())],
                         names=["doc_id", "text"])
        rows = [(doc, held) for part, texts in slices(plain) for doc, held in zip(ids(part.column("doc_id")).tolist(), sets_of(texts, n))]
        hub = table.column("hub")[0].as_py()
        probe = next((held for doc, held in rows if doc == hub), None)
        partners = [(doc, held) for doc, held in rows if doc != hub]
        if probe is None or not partners:
            return pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
        similar = PrefixTree([held for _, held in partners]).similar(probe, percent)
        return pa.table([pa.array([hub] * len(similar), pa.int64()), pa.array([partners[i][0] for i in similar], pa.int64())], names=["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (hub, doc_id) that are similar. A hub of many partners is spread over groups of about ``FAN``."""
    fans = pairs.groupBy("hub").agg(F.ceil(F.count("*") / FAN).alias("fans"))
    dealt = pairs.join(fans, "hub").select("hub", F.pmod(F.xxhash64("doc_id"), "fans").alias("fan"), "doc_id")
    hubs = fans.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fans") - 1)).alias("fan"), F.col("hub").alias("doc_id"))
    texts = sets.where("text is not null").select("doc_id", "text")
    return dealt.unionByName(hubs).join(texts, "doc_id").groupBy("hub", "fan").applyInArrow(_verified(n, percent), "a long, b long")


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Every document's size and class, and the shared prefix n-grams, marks and packed text of the first of a class."""
    late = frequent(docs, n)
    texts = blocks.packed(docs.where("doc_id is not null"))
    keys = texts.groupBy("block").applyInArrow(_keys(n, percent, late), "block int, key long, lo long, hi long")
    return durable(texts.groupBy("block").cogroup(_recurring(keys).groupBy("block")).applyInArrow(
        _reduced(n, percent, late), "doc_id long, n_shingles long, class long, tokens array<long>, marks array<long>, text binary"))


def ngram_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row.

    ``class_id`` is the least id with the same n-grams, ``component_id`` the least id that similar documents lead to.
    Null, empty and blank texts have no n-grams and form components of their own. Repeated rows repeat; rows without an
    id cannot be linked: they have their size, and null as class and component. Columns other than ``doc_id`` and ``text`` are not read.
    """
    sets = _sets(docs, n, percent)
    blocks.release(docs.sparkSession)
    shared = sets.where("tokens is not null").select("doc_id", F.col("n_shingles").alias("size"), "tokens", "marks")
    near = durable(_links(_nearest(shared, percent), sets, n, percent))
    blocks.release(docs.sparkSession)
    rest = durable(_links(_unconnected(shared, components(near), percent), sets, n, percent))
    blocks.release(docs.sparkSession)
    found = components(near.unionByName(rest))
    named = sets.join(found, sets["class"] == found["node"], "left").select(
        "doc_id", "n_shingles", F.col("class").alias("class_id"), F.coalesce("component", "class").alias("component_id"))
    nameless = docs.where("doc_id is null").select(F.col("text").cast("binary").alias("text"))
    if not nameless.limit(1).count():
        return named
    none = F.lit(None).cast("long")
    return named.unionByName(nameless.mapInArrow(_sizes(n), "n_shingles long").select(
        none.alias("doc_id"), "n_shingles", none.alias("class_id"), none.alias("component_id")))


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether sets of two sizes can be similar at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _marks_allow(a: str, b: str, percent: int) -> Column:
    """Whether the marks of two sets differ in no more places than similar sets of their sizes may differ in n-grams."""
    unlike = sum((F.bit_count(F.col(f"mark{i}_x").bitwiseXOR(F.col(f"mark{i}_y"))) for i in range(MARKS)), F.lit(0))
    overlap = F.expr(f"cast(ceil({percent} * ({a} + {b}) / {100 + percent}) as long)")
    return unlike <= F.col(a) + F.col(b) - 2 * overlap


def _least_common(a: str, b: str, percent: int) -> Column:
    """n-grams that the prefixes of similar sets of two sizes have in common at least: what one set holds and the other
    lacks, size - overlap at most, cannot fill the prefix."""
    overlap = F.expr(f"cast(ceil({percent} * ({a} + {b}) / {100 + percent}) as long)")
    return F.least(*[F.expr(f"{k} - cast(ceil({percent} * {k} / 100) as long) + 1") - (F.col(k) - overlap) for k in (a, b)])


def _nearest(shared: DataFrame, percent: int) -> DataFrame:
    """(hub, doc_id): for each set the least set of the groups it meets, where it meets one in groups enough."""
    index = shared.select("doc_id", "size", F.explode("tokens").alias("token"))
    least = index.groupBy("token").agg(F.min(F.struct("doc_id", "size")).alias("hub"), F.count("*").alias("docs")).where("docs > 1")
    met = index.join(least.select("token", F.col("hub.doc_id").alias("hub"), F.col("hub.size").alias("hub_size")), "token")
    counted = (met.where((F.col("doc_id") != F.col("hub")) & _alike("size", "hub_size", percent))
               .groupBy("doc_id", "size", "hub", "hub_size").agg(F.count("*").alias("common"))
               .where(F.col("common") >= _least_common("size", "hub_size", percent)))
    return counted.groupBy("doc_id").agg(F.max_by("hub", F.struct("common", -F.col("hub"))).alias("hub"))


def _unconnected(shared: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """(hub, doc_id): pairs with different labels that meet in as many groups as similar sets of their sizes must.

    In a group the members of its commonest label need not meet each other, so only the others look for partners, and only
    among those that share enough of their prefix with anything at all.
    """
    labelled = shared.join(label, shared["doc_id"] == label["node"], "left").select(
        "doc_id", "size", F.size("tokens").alias("held"), F.coalesce("component", "doc_id").alias("label"),
        *[F.get("marks", F.lit(i)).alias(f"mark{i}") for i in range(MARKS)], F.explode("tokens").alias("token"))
    counts = labelled.groupBy("token", "label").agg(F.count("*").alias("members"))
    mixed = (counts.groupBy("token").agg(F.max_by("label", F.struct("members", -F.col("label"))).alias("major"), F.count("*").alias("labels"))
             .where("labels > 1").drop("labels"))
    group = labelled.join(mixed, "token")
    one, two = (group.select("token", "major", *[F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "size", "held", "label", *[f"mark{i}" for i in range(MARKS)])]) for k in "xy")
    once = (F.col("label_y") == F.col("major")) | (F.col("doc_id_x") < F.col("doc_id_y"))
    want = _least_common("size_x", "size_y", percent)
    met = one.where("label_x <> major").drop("major").join(two, "token").where(
        (F.col("label_x") != F.col("label_y")) & once & _alike("size_x", "size_y", percent) & (F.least("held_x", "held_y") >= want)
        & _marks_allow("size_x", "size_y", percent))
    # which of two is x changes from group to group, so a pair is put in one order, its sizes along with it, before it is counted
    one, two = (F.struct(F.col(f"doc_id_{k}").alias("doc_id"), F.col(f"size_{k}").alias("size")) for k in "xy")
    pairs = met.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).select(
        *[F.col(f"{k}.{c}").alias(f"{c}_{k}") for k in "xy" for c in ("doc_id", "size")])
    counted = pairs.groupBy("doc_id_x", "size_x", "doc_id_y", "size_y").agg(F.count("*").alias("common")).where(F.col("common") >= want)
    return counted.select(F.col("doc_id_x").alias("hub"), F.col("doc_id_y").alias("doc_id")).distinct()
