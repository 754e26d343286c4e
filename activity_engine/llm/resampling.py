"""Documents drawn towards a target: log ratios of hashed word features, a Gumbel draw, and the exact best share.

Weights come from arrays: a text's words and word pairs become bucket numbers (CRC-32 of whole columns at once), and the
gain of each bucket is looked up in one array that every task has. The draw takes the highest scores without sorting the
rest: every task offers the median of the keys it still has in the race, weighted by how many those are. The weighted
median of the offers leaves at least an eighth of the race on either side; rows on the far side of the cutoff leave, and so on
until few enough are left to name the exact key at which the draw ends. Only the winners are sorted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from activity_engine.llm.words import binary, slices
from activity_engine.session import durable

BUCKETS = 10_000
#: Documents with fewer words are not drawn; the percentage of the others that is; the seed of the draw.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: The race ends by sorting once so few keys are left in it; a block of keys holds so many.
FEW, BLOCK = 4096, 1 << 16
#: A longer text is cut into pieces of about so many bytes, between words.
PIECE = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Longer words take zlib's own CRC, one at a time; they are at most one in so many bytes.
_LONG = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def _shift_tables(longest: int) -> np.ndarray:
    """tables[n][k][b]: what byte k of a CRC, when it is b, becomes after n more bytes. A CRC moves by the sum of its bytes."""
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]
    for n in range(1, longest + 1):
        out[n] = _TABLE[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


_SHIFT = _shift_tables(_LONG)
_SPACE = np.uint32(zlib.crc32(b" "))


def _moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs after ``length`` more zero bytes, of at most ``_LONG``."""
    out = _SHIFT[length, 0, crc & np.uint32(255)]
    for byte in (1, 2, 3):
        out ^= _SHIFT[length, byte, crc >> np.uint32(8 * byte) & np.uint32(255)]
    return out


def _joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of ``left + " " + right`` from those of both and the bytes of ``right``."""
    crc, left_over = _moved(left, np.ones(1, np.int64)) ^ _SPACE, length.copy()
    while True:
        step = np.minimum(left_over, _LONG)
        crc, left_over = _moved(crc, step), left_over - step
        if not left_over.any():
            return crc ^ right


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for each pair, byte by byte over all words at once."""
    length = ends - starts
    order = np.argsort(-np.minimum(length, _LONG + 1), kind="stable")
    at, rest = starts[order], length[order]
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    short = np.searchsorted(-rest, -_LONG, side="left")  # words before this one are longer
    at, rest, run = at[short:], rest[short:], crc[short:]
    more = len(rest) - np.searchsorted(rest[::-1], np.arange(1, _LONG + 1), side="left")
    for byte, n in enumerate(more):
        if not n:
            break
        run[:n] = _TABLE[(run[:n] ^ data[at[:n] + byte]) & np.uint32(255)] ^ (run[:n] >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = ~crc
    for i in order[:short]:
        out[i] = zlib.crc32(data[starts[i]: ends[i]])
    return out


def _words(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in texts that lie one after another, and each text's first word (and their number)."""
    word = _WORD[raw]
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:], after[:-1] = ~word[:-1], ~word[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _features(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all words, buckets of all pairs, whether a pair is one (both words in one text), first word of each text)."""
    starts, ends, first = _words(offsets, raw)
    crc = word_crcs(_LOWER[raw], starts, ends)
    pairs = _joined(crc[:-1], crc[1:], (ends - starts)[1:]) if len(crc) > 1 else np.zeros(0, np.uint32)
    inside = np.ones(len(pairs), bool)
    border = first[1:-1]
    inside[border[(border > 0) & (border < len(crc))] - 1] = False
    return crc % BUCKETS, pairs % BUCKETS, inside, first


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about ``PIECE`` bytes that end before a break between words."""
    start = 0
    while start < len(text):
        found = _BREAK.search(text, start + PIECE)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def _long(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of a long text, words and pairs, piece by piece; yields (words, pairs)."""
    last = None
    for piece in _pieces(text):
        raw = np.frombuffer(piece, np.uint8)
        starts, ends, _ = _words(np.array([0, len(raw)]), raw)
        crc, length = word_crcs(_LOWER[raw], starts, ends), ends - starts
        if not len(crc):
            continue
        left = crc[:-1] if last is None else np.r_[last, crc[:-1]]
        right, size = (crc[1:], length[1:]) if last is None else (crc, length)
        yield crc % BUCKETS, (_joined(left, right, size) if len(right) else right) % BUCKETS
        last = crc[-1:]


def _taken(batch: pa.RecordBatch):
    """(rows, offsets, bytes) of slices of a batch; one of a single text over ``PIECE`` bytes has no offsets."""
    at = 0
    for part, texts in slices(batch):
        rows, at = slice(at, at + part.num_rows), at + part.num_rows
        if part.num_rows == 1 and len(texts[0].as_buffer()) > PIECE:
            yield rows, None, texts[0].as_py()
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset:].astype(np.int64)
        whole = texts.buffers()[2]
        raw = np.frombuffer(whole, np.uint8)[offsets[0]: offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
        yield rows, offsets - offsets[0], raw


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, offsets, data in _taken(batch):
            if offsets is None:
                for some in _long(data):
                    total += sum(np.bincount(x, minlength=BUCKETS) for x in some)
            else:
                words, pairs, inside, _ = _features(offsets, data)
                total += np.bincount(words, minlength=BUCKETS) + np.bincount(pairs[inside], minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    partial = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(_count, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in partial.groupBy("bucket").agg(F.sum("n")).collect():  # at most a row a bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed target share over the smoothed source share) of each bucket."""
    above = (target + 1).astype(np.float64) * float(int(source.sum()) + BUCKETS)
    below = (source + 1).astype(np.float64) * float(int(target.sum()) + BUCKETS)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for rows, offsets, data in _taken(batch):
                if offsets is None:
                    for words, pairs in _long(data):
                        n_words[rows] += len(words)
                        n_features[rows] += len(words) + len(pairs)
                        total[rows] += int(gain[words].sum()) + int(gain[pairs].sum())
                    continue
                words, pairs, inside, first = _features(offsets, data)
                begin, end = first[:-1], first[1:]
                n = end - begin
                upto = np.r_[0, np.cumsum(gain[words])]
                paired = np.r_[0, np.cumsum(np.where(inside, gain[pairs], 0))]
                last = np.maximum(end - 1, begin)
                n_words[rows] = n
                n_features[rows] = n + np.maximum(n - 1, 0)
                total[rows] = upto[end] - upto[begin] + paired[np.minimum(last, len(pairs))] - paired[np.minimum(begin, len(pairs))]
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return run


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row: the weight plus a Gumbel number that the seed and id decide."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    weighed = rows.mapInArrow(_weigh(gain), "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = (F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(drawn))).cast("long"))


# The race. A key is (-score, doc_id, n_features, row): the least keys win, and no two rows share one.

def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            columns = [batch.column(c).slice(start, BLOCK).to_numpy(zero_copy_only=False) for c in ("a", "b", "c", "d")]
            keys = np.stack(columns, 1)[np.lexsort(columns[::-1])]
            yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64()), pa.array([keys.astype("<i8").tobytes()])], names=["n", "keys"])


def _place(keys: np.ndarray, key: tuple) -> int:
    """How many of the sorted ``keys`` are at most ``key``."""
    low, high = 0, len(keys)
    while low < high:
        middle = (low + high) // 2
        if tuple(keys[middle].tolist()) <= key:
            low = middle + 1
        else:
            high = middle
    return low


def _weighted_median(offers: list[tuple[tuple, int]]) -> tuple:
    """The least key so that it and lesser ones hold at least half of the weight."""
    half, run = sum(n for _, n in offers) / 2, 0
    for key, n in sorted(offers):
        run += n
        if run >= half:
            return key
    raise ValueError("no offers")


def _open(batches: Iterator[pa.RecordBatch], after: tuple | None, upto: tuple | None) -> Iterator[np.ndarray]:
    """The keys of each block that are still in the race: above ``after``, at most ``upto``."""
    for batch in batches:
        for held in batch.column("keys"):
            keys = np.frombuffer(held.as_buffer(), "<i8").reshape(-1, 4)
            low = _place(keys, after) if after else 0
            high = _place(keys, upto) if upto else len(keys)
            if low < high:
                yield keys[low:high]


_KEY = "a long, b long, c long, d long"


def _offer(after: tuple | None, upto: tuple | None):
    """A task's median of its blocks' medians, and how many keys it has in the race."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offers = [(tuple(keys[(len(keys) - 1) // 2].tolist()), len(keys)) for keys in _open(batches, after, upto)]
        if offers:
            row = (*_weighted_median(offers), sum(n for _, n in offers))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["a", "b", "c", "d", "n"])

    return run


def _below(after: tuple | None, upto: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len(keys) for keys in _open(batches, after, upto))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def _left(after: tuple | None, upto: tuple | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _open(batches, after, upto):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, i])) for i in range(4)], names=["a", "b", "c", "d"])

    return run


def cutoff(blocks: DataFrame, k: int) -> tuple:
    """The ``k``-th least key of all blocks, for 1 <= k <= their keys."""
    after = upto = None
    while True:
        offers = [(tuple(r[:4]), r.n) for r in blocks.mapInArrow(_offer(after, upto), f"{_KEY}, n long").collect()]
        if sum(n for _, n in offers) <= FEW:
            return sorted(tuple(r) for r in blocks.mapInArrow(_left(after, upto), _KEY).collect())[k - 1]
        pivot = _weighted_median(offers)
        n = blocks.mapInArrow(_below(after, pivot), "n long").agg(F.sum("n")).first()[0]
        if k == n:
            return pivot
        if k < n:
            upto = pivot
        else:
            after, k = pivot, k - n


def _ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with their rank by key: range-partitioned, sorted, and counted by partition."""
    ordered = durable(winners.repartitionByRange("__a", "__b", "n_features", "__row").sortWithinPartitions("__a", "__b", "n_features", "__row")
                      .withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    begun = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__begun"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("__part", part).join(F.broadcast(begun), "__part").withColumn("rank", F.col("__begun") + inside + 1)


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 and so on for the highest ``percent`` in a hundred (rounded down) of those rows that
    have ``least_words`` words, null for the others. Ties go to the smaller id (null last), then to fewer features; rows alike in
    all of this are interchangeable, and as many of them are drawn as fit."""
    columns = scored.columns
    held = durable(scored.withColumn("__a", -F.col("score")).withColumn("__b", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
                   .withColumn("__row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least_words
    keys = held.where(able).select(F.col("__a").alias("a"), F.col("__b").alias("b"), F.col("n_features").alias("c"), F.col("__row").alias("d"))
    blocks = durable(keys.mapInArrow(_blocks, "n long, keys binary"))
    k = percent * (blocks.agg(F.sum("n")).first()[0] or 0) // 100
    none = F.lit(None).cast("long")
    if not k:
        return held.select(*columns, none.alias("rank"))
    a, b, c, d = cutoff(blocks, k)
    last = F.struct(*[F.lit(x).cast("long") for x in (a, b, c, d)])
    won = able & (F.struct("__a", "__b", "n_features", "__row") <= last)
    return _ranked(held.where(won)).select(*columns, "rank").unionByName(held.where(~won).select(*columns, none.alias("rank")))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``, drawn towards the texts of ``target``.

    A null text is empty: no features, weight 0. A row without an id is drawn as if its name were empty, and loses ties. Repeated rows
    count and are ranked repeatedly. An empty target makes common features poor and rare ones good. Other columns are not read.
    """
    return draw(scores(docs, gains(bucket_counts(docs), bucket_counts(target))))


def digest(drawn: DataFrame) -> DataFrame:
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
