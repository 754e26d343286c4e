"""Token ids in files of byte-aligned, frequency-ranked codes with separate control bytes.

The file is a Parquet table of chunks. A chunk holds whole documents in ascending ``doc_id`` order:

* ``part``, ``chunk``: its place; parts follow one another, and so do the chunks of a part,
* ``doc_ids``, ``lengths``: its documents and how many ids each has,
* ``table``: little-endian 32-bit ids, the commonest of the chunk first; an id is written as its rank here,
* ``control``: two bits for each rank, four ranks a byte, first rank lowest: the rank's bytes less one,
* ``data``: the ranks' bytes, lowest first, without gaps.

Reading looks each control byte up in a table of four lengths, and sums of lengths give every rank's place.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from activity_engine.llm.blocks import shuffle_partitions
from activity_engine.llm.words import gathered, slices
from activity_engine.session import ensure_checkpoint_dir

#: A chunk is closed once it holds so many ids; its last document may go beyond.
CHUNK = 1 << 21
END = 2
#: Distinct words whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 1_000_000
#: Texts of about so many bytes are cut into words together; a word is looked up once for all of them.
AT_ONCE = 8 << 20
#: So many unknown words are encoded as one text.
TOGETHER = 64
CHUNKS = "part int, chunk int, doc_ids array<long>, lengths array<long>, table binary, control binary, data binary"
_CHUNKS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                     ("table", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
LENGTHS = np.array([[1 + (byte >> shift & 3) for shift in (0, 2, 4, 6)] for byte in range(256)], np.uint8)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(table, control, data) of 32-bit ids. Ids of equal frequency rank by value."""
    if len(ids) and int(ids.max()) < 1 << 24:  # a table over all values is faster than sorting the ids
        count = np.bincount(ids)
        found = np.flatnonzero(count)
        count, place = count[found], ids
    else:
        found, place, count = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(int(found[-1]) + 1 if place is ids and len(found) else len(found), np.uint32)
    rank[found[order] if place is ids else order] = np.arange(len(found), dtype=np.uint32)
    ranks = rank[place]
    extra = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    for bits in (8, 16, 24):
        extra[:len(ranks)] += ranks >= 1 << bits
    control = (extra.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    width = extra[:len(ranks)].astype(np.int64) + 1
    begin = np.cumsum(width) - width
    data = np.empty(int(width.sum()), np.uint8)
    for byte in range(4):
        mine = width > byte if byte else slice(None)
        data[begin[mine] + byte] = ranks[mine] >> np.uint32(8 * byte) & np.uint32(255)
    return found[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def unpack(table: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of a chunk."""
    width = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(width, dtype=np.int64)
    begin = end - width
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[begin].astype(np.uint32)
    for byte in range(1, 4):
        mine = np.flatnonzero(width > byte)
        if not len(mine):
            break
        ranks[mine] |= raw[begin[mine] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return np.frombuffer(table, "<u4")[ranks]


def _stems(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words in small letters, and for each the stop or comma that was its last byte and is taken off (after a letter only), else 0."""
    joined = b" ".join(words).lower()
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    raw = np.frombuffer(b"  " + joined, np.uint8)  # so that the last two bytes of every word have a place
    last, before = raw[end + 1], raw[end]
    mark = np.where((size > 1) & ((last == ord(".")) | (last == ord(","))) & (before >= ord("a")) & (before <= ord("z")), last, 0)
    lower = joined.split(b" ") if words else []
    for at in np.flatnonzero(mark).tolist():
        lower[at] = lower[at][:-1]
    return lower, mark


class WordEncoder:
    """Ids of whole texts, word by word. Only for tokenizers that drop white space, never join across it, lower the case,
    and part letters from marks: each distinct word is then encoded once and remembered. Words are cut at ASCII white space
    only; a word may hold other spaces. ``encode`` gives all ids of some words, one word after another, and how many each has."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.stems: dict[bytes, int] = {}
        self.begin = self.length = np.zeros(0, np.int64)
        self.stem_begin = self.stem_length = np.zeros(0, np.int64)
        self.ids = self.stem_ids = np.zeros(0, np.uint32)

    def _learn(self, new: list[bytes]) -> None:
        """Words that only differ in the case of A-Z, or in one stop or comma after a letter, share a stem. Words that may hold
        a special token stay as they are."""
        whole = [at for at, w in enumerate(new) if b"<|" in w]
        stems, mark = _stems(new)
        for at in whole:
            stems[at] = new[at]
        mark[whole] = 0
        unknown = list({*stems, b".", b","}.difference(self.stems))
        ids, length = self.encode([w.decode("utf-8", "replace") for w in unknown])
        self.stems.update(zip(unknown, range(len(self.stems), len(self.stems) + len(unknown))))
        self.stem_begin = np.r_[self.stem_begin, len(self.stem_ids) + np.cumsum(length) - length]
        self.stem_length = np.r_[self.stem_length, length]
        self.stem_ids = np.r_[self.stem_ids, ids]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        # a word is written as its stem and its mark, one after the other
        parts = np.full((len(new), 2), -1, np.int64)
        parts[:, 0] = np.fromiter(map(self.stems.__getitem__, stems), np.int64, len(stems))
        for byte in b".,":
            parts[mark == byte, 1] = self.stems[bytes([byte])]
        long = np.where(parts < 0, 0, self.stem_length[parts])
        coded = gathered(self.stem_ids, self.stem_begin[parts].reshape(-1), long.reshape(-1))
        length = long.sum(axis=1)
        self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(length) - length]
        self.length = np.r_[self.length, length]
        self.ids = np.r_[self.ids, coded]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has. Texts are bytes, none of them null."""
        words = pc.ascii_split_whitespace(texts.view(pa.string()))
        each = words.flatten().dictionary_encode()
        distinct = each.dictionary.view(pa.binary()).to_pylist()
        if len(self.place) > REMEMBERED:
            self._forget()
        new = [w for w in distinct if w not in self.place]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[each.indices.to_numpy()]
        length = self.length[at]
        ids = gathered(self.ids, self.begin[at], length)
        upto = np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(pc.list_value_length(words).to_numpy())]]
        return ids, np.diff(upto)


_ENCODERS: dict[str, WordEncoder] = {}


def word_tokenizer(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, one per worker process."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        marks = [(t.content, i) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized and not t.lstrip and not t.rstrip]

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Every call of the library costs something by itself, so words go together, with a special token between them."""
            if marks:
                mark, id_ = marks[0]
                runs = tokenizer.encode_batch_fast([mark.join(words[at:at + TOGETHER]) for at in range(0, len(words), TOGETHER)], add_special_tokens=False)
                ids = np.concatenate([np.zeros(0, np.uint32), *[np.array([*run.ids, id_], np.uint32) for run in runs]])
                length = np.diff(np.flatnonzero(ids == id_), prepend=-1) - 1
                if len(length) == len(words):  # else a word holds that token itself
                    return ids[ids != id_], length
            coded = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            length = np.fromiter(map(len, coded), np.int64, len(coded))
            return np.fromiter(chain.from_iterable(coded), np.uint32, int(length.sum())), length

        _ENCODERS[path] = WordEncoder(encode)
    return _ENCODERS[path]


def _chunks(path: str, end: int, size: int):
    """Encode a part's documents, which come in order, and close a chunk whenever it is full."""
    def packed(part: int, number: int, docs: list, lengths: list, ids: list) -> pa.RecordBatch:
        table, control, data = pack(np.concatenate(ids))
        row = [[part], [number], [docs], [lengths], [table], [control], [data]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _CHUNKS)], schema=_CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = word_tokenizer(path), 0, 0
        docs, lengths, ids, held = [], [], [], 0
        for batch in batches:
            for run_, texts in slices(batch, AT_ONCE):
                coded, count = encoder(texts)
                stops = np.cumsum(count)
                ended = np.insert(coded, stops, np.uint32(end))
                part = batch.column("part")[0].as_py()
                docs += run_.column("doc_id").to_pylist()
                lengths += (count + 1).tolist()
                ids.append(ended)
                held += len(ended)
                if held >= size:
                    yield packed(part, number, docs, lengths, ids)
                    docs, lengths, ids, held, number = [], [], [], 0, number + 1
        if docs:
            yield packed(part, number, docs, lengths, ids)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, where: str, end: int = END, chunk: int = CHUNK) -> None:
    """Write the ids of every text of ``docs``, each followed by ``end``, to a new folder ``where``, ascending by ``doc_id``.

    ``tokenizer`` is the path of a tokenizer file of the kind ``WordEncoder`` takes, the same on every worker. Null counts
    as an empty text, which has the end id alone; rows without an id come first; repeated rows are written repeatedly.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sorted_ = rows.repartitionByRange(shuffle_partitions(docs), "doc_id").sortWithinPartitions("doc_id")
    (sorted_.withColumn("part", F.spark_partition_id()).mapInArrow(_chunks(tokenizer, end, chunk), CHUNKS)
     .write.option("compression", "none").parquet(where))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.array(row["lengths"], np.int64)
            ids = unpack(row["table"], row["control"], row["data"], int(lengths.sum())).astype("<u4")
            stop = np.cumsum(lengths)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(stop - lengths, stop)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["chunk"], np.int32)),
                pa.array(row["doc_ids"], pa.int64()), pa.array(stop - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                names=["part", "chunk", "doc_id", "begin", "n_tokens", "ids_crc32"])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.array(row["lengths"], np.int64)
            ids = unpack(row["table"], row["control"], row["data"], int(lengths.sum())).astype(np.int64)
            offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids))],
                                             names=["doc_id", "ids"])


def read_tokens(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, ids) of a folder of token files."""
    return spark.read.parquet(where).mapInArrow(_ids, "doc_id long, ids array<long>")


def token_index(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone; ``start`` counts the ids of all documents before."""
    chunks = spark.read.parquet(where)
    totals = chunks.select("part", "chunk", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part, and parts are as many as shuffle partitions
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    begun = totals.select("part", "chunk", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("before")).join(parts, "part")
    docs = chunks.mapInArrow(_read, "part int, chunk int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return docs.join(begun, ["part", "chunk"]).select(
        "doc_id", (F.col("base") + F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder that the cluster names for checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
