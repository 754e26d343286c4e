"""SentencePiece encoding and decoding with a relational lattice.

A text is cut into *units* that no piece crosses: runs of spaces with the word after them, and control characters. Every
distinct unit is encoded once: its substrings of bounded length are exploded, joined to the table of pieces, gathered as
edges of the unit's lattice, and folded with Spark's ``aggregate``:

* unigram models: Viterbi, the best score over all paths, position by position;
* merge (BPE) models, whose ids no best path gives: the merges themselves, the best remaining edge that joins two
  neighbouring symbols first, the leftmost of equals.

Symbols without a piece become byte pieces. Texts and units meet by block, some documents named by a hash of what they
hold: its texts travel as numbers of units, its distinct units get their ids, and both are put together again. A block
sends its units packed, one row for each part of all units (by CRC-32), and their ids come back the same way; only the
distinct units of a part are rows. Decoding joins pieces, turns byte pieces into bytes and takes the first space off.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import tee

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.llm.blocks import shuffle_partitions
from activity_engine.llm.words import binary, gathered, give_back, slices

MARK = "▁"
#: Longer units (in characters) are left to the library itself, one at a time: the places of a unit are bits of a long, and
#: one more tells the fold that it has ended.
LONGEST = 60
BPE, UNIGRAM = 2, 1
#: Characters by which a substring's pieces are bounded.
_BEGIN = 3
#: Parts of units for each shuffle partition. A unit's lattice is some twenty rows, so a part is an eighth of a partition of texts.
PARTS = 8
#: Texts of about so many bytes are a block.
BLOCK = 15 << 20
#: Units of texts that are given their ids in one go, about.
_UNITS_AT_ONCE = 1 << 18
#: So many texts are decoded in one go.
_AT_ONCE = 256
_RESULT = "doc_id long, ids array<int>"
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


@dataclass(frozen=True)
class Model:
    """A SentencePiece model: its pieces, and what tasks need to know of it. The file has the same path on every worker."""

    path: str
    kind: int
    pieces: tuple[tuple[str, int, float], ...]
    bytes_from: int
    longest: int

    @staticmethod
    def load(path: str) -> Model:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as file:
            raw = proto.ModelProto.FromString(file.read())
        processor = SentencePieceProcessor(model_file=path)
        size = len(processor)
        plain = [i for i in range(size) if not (processor.is_unknown(i) or processor.is_control(i) or processor.is_byte(i) or processor.is_unused(i))]
        if raw.normalizer_spec.name != "identity" or not raw.normalizer_spec.add_dummy_prefix or raw.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that keep texts as they are and add a first space")
        pieces = tuple((processor.id_to_piece(i), i, processor.get_score(i)) for i in plain)
        if any(MARK in p.lstrip(MARK) for p, _, _ in pieces):
            raise ValueError("a piece crosses words")
        return Model(path, raw.trainer_spec.model_type, pieces, processor.piece_to_id("<0x00>"), max(len(p) for p, _, _ in pieces))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.pieces), "piece string, id int, score double")


_UNITS = re.compile(f"{MARK}*[^{MARK}\x00-\x1f]+|{MARK}+|[\x00-\x1f]")


def units(text: str) -> list[str]:
    """The units of a text; an empty text has none. Control characters stand alone, as no piece holds one."""
    return _UNITS.findall(MARK + text.replace(" ", MARK)) if text else []


def _name(batch: pa.RecordBatch, texts: pa.Array) -> int:
    """The name of a block, a hash of its ids and texts that is below 0."""
    name = xxhash.xxh3_64()
    for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
        raw = text.as_buffer()
        name.update(f"{doc},{raw.size};")
        name.update(raw)
    return (name.intdigest() >> 1) - (1 << 63)


def _numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct units of texts, the units of all texts as numbers, how many each text has). Where single spaces part words,
    every distinct word is cut once; most are one unit."""
    try:
        told = texts.cast(pa.string())
    except pa.ArrowInvalid:
        told = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
    # where spaces or marks meet, a unit holds several: such texts are cut one at a time
    apart = pc.match_substring_regex(told, f"  |^ | $|{MARK}").to_numpy(zero_copy_only=False) | (pc.binary_length(told).to_numpy() == 0)
    words = pc.split_pattern(told.filter(pa.array(~apart)), " ")
    held, each = pc.list_value_length(words).to_numpy(), words.flatten().dictionary_encode()
    del words
    distinct, at = each.dictionary, each.indices.to_numpy()
    several = pc.match_substring_regex(distinct, "[\x00-\x1f]").to_numpy(zero_copy_only=False)
    whole = distinct.filter(pa.array(~several))
    plain = pc.binary_join_element_wise(MARK, whole, "").cast(pa.binary())
    # the others first have numbers of their own
    place: dict[str, int] = {}
    cut = [[place.setdefault(u, len(place)) for u in _UNITS.findall(MARK + w)] for w in distinct.filter(pa.array(several)).to_pylist()]
    alone = [np.array([place.setdefault(u, len(place)) for u in units(told[i].as_py())], np.int64) for i in np.flatnonzero(apart).tolist()]
    others = pa.array([u.encode() for u in place], pa.binary())
    number = pc.fill_null(pc.index_in(others, plain), -1).to_numpy().astype(np.int64)
    new = number < 0
    number[new] = len(plain) + np.arange(new.sum())

    begin, size = np.zeros(len(distinct), np.int64), np.ones(len(distinct), np.int32)
    begin[~several] = np.arange(len(whole))
    size[several] = [len(c) for c in cut]
    begin[several] = len(whole) + np.cumsum(size[several]) - size[several]
    values = np.r_[np.arange(len(whole)), number[[i for c in cut for i in c]]].astype("<u4")
    numbers = [np.zeros(0, "<u4")]
    for some in range(0, len(at), _UNITS_AT_ONCE):
        mine = at[some:some + _UNITS_AT_ONCE]
        numbers.append(gathered(values, begin[mine], size[mine]))
    sizes = np.zeros(len(told), np.int64)
    sizes[~apart] = np.diff(np.r_[0, np.cumsum(size[at], dtype=np.int32)][np.r_[0, np.cumsum(held)]])
    sizes[apart] = [len(c) for c in alone]
    out = np.concatenate(numbers)
    if len(out) < sizes.sum():
        mine, plainly = np.repeat(apart, sizes), out
        out = np.empty(len(mine), "<u4")
        out[~mine], out[mine] = plainly, number[np.concatenate(alone)]
    return pa.concat_arrays([plain, others.filter(pa.array(new))]), out, sizes


def _dealt(texts: pa.Array, parts: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct units, the part of each, numbers of all texts, how many each text has). The commonest units come first, so
    that numbers are small; overlong units have the part after the last."""
    found, numbers, sizes = _numbered(texts)
    order = np.argsort(-np.bincount(numbers, minlength=len(found)), kind="stable")
    found = found.take(pa.array(order))
    rank = np.empty(len(order), "<u4")
    rank[order] = np.arange(len(order))
    part = np.empty(len(found), "<u4")
    for some in range(0, len(found), 1 << 16):
        part[some:some + (1 << 16)] = [zlib.crc32(u) % parts for u in found[some:some + (1 << 16)].to_pylist()]
    part[pc.utf8_length(found.cast(pa.string())).to_numpy() > LONGEST] = parts
    return found, part, rank[numbers], sizes


_SENT = pa.schema([
    ("key", pa.int64()), ("block", pa.int64()), ("units", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
    ("parts", pa.binary()), ("numbers", pa.binary()), ("long", pa.list_(pa.list_(pa.int32())))])
_SENT_SQL = "key long, block long, units binary, doc_ids array<long>, lengths array<int>, parts binary, numbers binary, long array<array<int>>"


def _sent(path: str, parts: int):
    """Rows of two kinds, so that texts are cut once. By part: the distinct units of a block, packed; no unit holds a space. By
    block: its texts as numbers of units, byte by byte, the part of each unit, and the ids of overlong units."""
    def rows(batch: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        block = _name(batch, texts)
        found, part, numbers, lengths = _dealt(texts, parts)
        edges = np.searchsorted(np.sort(part), np.arange(parts + 2))
        found = found.take(pa.array(np.argsort(part, kind="stable")))
        some = np.flatnonzero(np.diff(edges[:-1])).tolist()
        units_ = [zstandard.compress(b" ".join(found[edges[p]:edges[p + 1]].to_pylist())) for p in some]
        planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T)
        long = [_long_unit(path, u.decode()) for u in found[edges[parts]:].to_pylist()]
        none = [None] * len(some)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((
            [*some, block], [block] * (len(some) + 1), [*units_, None], [*none, batch.column("doc_id").to_pylist()], [*none, lengths],
            [*none, zstandard.compress(part.data)], [*none, zstandard.compress(planes.data)], [*none, long]), _SENT.types)], schema=_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            # blocks of a batch are even: the last is as large as the others, and none is larger than it must be
            held = batch.column("text").nbytes + batch.num_rows
            for some, texts in slices(batch, held // -(-held // BLOCK) + 1 if held else BLOCK):
                found = rows(some, texts)
                give_back()
                yield found

    return run


def _opened(packed: pa.Scalar) -> list[bytes]:
    return zstandard.decompress(packed.as_buffer()).split(b" ")


def _distinct(sent: pa.Table) -> pa.Table:
    """(part, unit) of the distinct units of a part; a block's texts have none."""
    found: set[bytes] = set()
    for packed in sent.column("units").drop_null():
        found.update(_opened(packed))
    part, told = sent.column("key")[0].as_py(), pa.array(list(found), pa.binary()).cast(pa.string())
    out = pa.table([pa.array(np.full(len(found), part)), told], names=["part", "unit"])
    del found
    give_back()
    return out


def _coded(wide: int):
    """(block, part, n, ids): for each block's units of a part how many ids they have (16 bits), then all their ids, packed."""
    def run(sent: pa.Table, coded: pa.Table) -> pa.Table:
        sent = sent.filter(pc.is_valid(sent.column("units")))
        place = {u: i for i, u in enumerate(binary(coded.column("unit")).to_pylist())}
        lists = coded.column("ids").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        length = pc.list_value_length(lists).to_numpy().astype(np.int64)
        begin, ids = np.cumsum(length) - length, lists.flatten().to_numpy().astype(f"<u{wide}")
        n, packed = [], []
        for units_ in sent.column("units"):
            at = np.fromiter(map(place.__getitem__, _opened(units_)), np.int64)
            n.append(len(at))
            packed.append(zstandard.compress(length[at].astype("<u2").tobytes() + gathered(ids, begin[at], length[at]).tobytes()))
        out = pa.table([sent.column("block"), sent.column("key"), pa.array(n, pa.int32()), pa.array(packed, pa.binary())],
                       names=["block", "part", "n", "ids"])
        del place, lists, length, begin, ids
        give_back()
        return out

    return run


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def lattices(found: DataFrame, pieces: DataFrame, longest: int, unknown: float) -> DataFrame:
    """``found`` and the edges of distinct units: every substring that is a piece, the best score and then the leftmost first.

    ``bounds`` holds the bits of an edge's two ends, ``inside`` those of the places between them, ``id`` the piece. A character
    without a piece is an edge as well, of score ``unknown`` and without an id.
    """
    n = F.length("unit")
    kept = [*found.columns, "row"]
    starts = found.select("*", F.monotonically_increasing_id().alias("row")).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    # no piece is longer than the longest that begins with the same characters
    begins = pieces.where(F.length("piece") >= _BEGIN).groupBy(F.substring("piece", 1, _BEGIN).alias("begin")).agg(F.max(F.length("piece")).alias("most"))
    bounded = starts.withColumn("begin", F.substring("unit", F.col("start") + 1, F.lit(_BEGIN))).join(F.broadcast(begins), "begin", "left")
    most = F.least(F.lit(longest), n - F.col("start"), F.coalesce("most", F.lit(_BEGIN - 1)))
    spans = bounded.select(*kept, "start", F.explode(F.sequence(F.lit(1), most)).alias("size"))
    cut = spans.select(*kept, "start", (F.col("start") + F.col("size")).alias("stop"),
                       F.substring("unit", F.col("start") + 1, F.col("size")).alias("piece"))
    # the vocabulary of one model, which does not grow with the texts
    met = cut.join(F.broadcast(pieces), "piece", "left").where("id is not null or stop = start + 1")
    edge = F.struct((-F.coalesce("score", F.lit(unknown))).alias("cost"), "start", "stop", (_bit(F.col("start")) + _bit(F.col("stop"))).alias("bounds"),
                    (_bit(F.col("stop")) - _bit(F.col("start") + 1)).alias("inside"), "id")
    # numbers of rows stand in order, so gathering them sorts next to nothing; units would be compared letter by letter
    others = [F.first(c).alias(c) for c in found.columns if c != "part"]
    return met.groupBy("row", *[c for c in found.columns if c == "part"]).agg(*others, F.sort_array(F.collect_list(edge)).alias("edges")).select(*found.columns, "edges")


def merged(unit: Column, edges: Column) -> Column:
    """The places where the symbols that remain after all merges end, 0 among them, as bits."""
    n = F.length(unit)

    def joins_two(places: Column, e: Column) -> Column:
        return (places.bitwiseAND(e["bounds"]) == e["bounds"]) & (F.bit_count(places.bitwiseAND(e["inside"])) == 1)

    def fold(open_: Column) -> Column:
        def step(places: Column, _: Column) -> Column:
            # edges are sorted, so the first that is ready is the best one; when none is, the sign says so
            best = F.get(F.filter(open_, lambda e: joins_two(places, e)), F.lit(0))["inside"]
            return F.when(places < 0, places).otherwise(F.coalesce(
                places.bitwiseAND(F.bitwise_not(best)), places.bitwiseOR(F.lit(-1 << 63))))

        # each merge takes a symbol away
        return F.aggregate(F.sequence(F.lit(1), n), _bit(n + 1) - 1, step, lambda places: places.bitwiseAND(F.lit((1 << 63) - 1)))

    return F.get(F.transform(F.array(F.filter(edges, lambda e: e["inside"] != 0)), fold), F.lit(0))


def viterbi(unit: Column, edges: Column) -> Column:
    """The places where the symbols of the best path end, 0 among them, as bits; of equal paths the longer last symbol."""
    first = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("start"), F.lit(1).cast("long").alias("places")))

    def reach(best: Column, stop: Column) -> Column:
        into = F.transform(F.filter(edges, lambda e: e["stop"] == stop), lambda e: F.struct(
            (F.get(best, e["start"])["cost"] + e["cost"]).alias("cost"), e["start"].alias("start"),
            (F.get(best, e["start"])["places"] + _bit(stop)).alias("places")))
        return F.concat(best, F.array(F.array_min(into)))

    return F.aggregate(F.sequence(F.lit(1), F.length(unit)), first, reach, lambda best: F.element_at(best, -1)["places"])


def unit_ids(found: DataFrame, model: Model) -> DataFrame:
    """``found`` and the ids of its distinct units of at most ``LONGEST`` characters; a symbol without a piece gives its UTF-8 bytes as byte pieces."""
    least = min((s for _, _, s in model.pieces), default=0.0)
    made = lattices(found, model.table(found.sparkSession), model.longest, least - 10)
    unit, edges = F.col("unit"), F.col("edges")
    places = merged(unit, edges) if model.kind == BPE else viterbi(unit, edges)

    def raw(start: Column) -> Column:
        digits = F.hex(F.encode(F.substring(unit, start + 1, F.lit(1)), "utf-8"))
        return F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: (
            F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int") + F.lit(model.bytes_from)))

    def ids(places: Column) -> Column:
        symbols = F.filter(edges, lambda e: places.bitwiseAND(e["bounds"] + e["inside"]) == e["bounds"])
        # start and id in one number sort faster than structs, and most units need no more
        told = F.transform(F.sort_array(F.transform(symbols, lambda e: F.call_function("shiftleft", e["start"].cast("long"), F.lit(32)) + e["id"])),
                           lambda known: known.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
        spelled = F.flatten(F.sort_array(F.transform(symbols, lambda e: F.struct(
            e["start"].alias("start"), F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(raw(e["start"])).alias("ids"))))["ids"])
        return F.when(F.forall(symbols, lambda e: e["id"].isNotNull()), told).otherwise(spelled)

    # an array of one, so that the fold is not done again for every edge
    return made.select(*found.columns, F.flatten(F.transform(F.array(places), ids)).cast("array<int>").alias("ids"))


_PROCESSORS: dict = {}


def _long_unit(path: str, unit: str) -> list[int]:
    """Ids of one unit by the library, which puts a space before what it is given."""
    if path not in _PROCESSORS:
        from sentencepiece import SentencePieceProcessor

        _PROCESSORS[path] = SentencePieceProcessor(model_file=path)
    library = _PROCESSORS[path]
    if unit.startswith(MARK):
        return library.encode(unit[1:].replace(MARK, " "))
    apart = library.encode("\n")  # a control character keeps the first space from the unit
    return library.encode("\n" + unit.replace(MARK, " "))[len(apart):]


def _joined(wide: int):
    """Put the ids of a block's units where its texts have their numbers."""
    def run(sent: pa.Table, coded: pa.Table) -> pa.Table:
        if not pc.any(pc.is_valid(sent.column("numbers"))).as_py():
            return _IDS.empty_table()
        # equal batches are one block, whose parts came once for each of them
        parts = {part: (n, ids.as_buffer()) for part, n, ids in zip(coded.column("part").to_pylist(), coded.column("n").to_pylist(), coded.column("ids"))}
        sizes, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for part in sorted(parts):
            n, packed = parts[part]
            raw = zstandard.decompress(packed)
            sizes.append(np.frombuffer(raw, "<u2", n).astype(np.int64))
            runs.append(np.frombuffer(raw, f"<u{wide}", offset=2 * n).astype(np.int32))
        out = []
        for row in sent.to_pylist():
            part, length = np.frombuffer(zstandard.decompress(row["parts"]), "<u4"), np.concatenate(sizes)
            if len(length) + len(row["long"]) != len(part):
                raise ValueError("units of a block are missing")
            order = np.argsort(part, kind="stable")
            length = np.r_[length, np.array([len(ids) for ids in row["long"]], np.int64)]
            flat = np.concatenate([*runs, *[np.array(ids, np.int32) for ids in row["long"]]])
            begin = np.cumsum(length) - length
            length[order], begin[order] = length.copy(), begin.copy()
            planes = np.frombuffer(zstandard.decompress(row["numbers"]), np.uint8).reshape(4, -1)
            upto, first = np.r_[0, np.cumsum(np.array(row["lengths"], np.int64))], 0
            while first < len(upto) - 1:
                last = max(first + 1, int(np.searchsorted(upto, upto[first] + _UNITS_AT_ONCE, "right")) - 1)
                numbers = np.ascontiguousarray(planes[:, upto[first]:upto[last]].T).view("<u4").reshape(-1)
                each = length[numbers]
                size = np.r_[0, np.cumsum(each)][upto[first:last + 1] - upto[first]].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(size), pa.array(gathered(flat, begin[numbers], each)))
                out.append(pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][first:last], pa.int64()), ids], schema=_IDS))
                first = last
        give_back()
        return pa.Table.from_batches(out, _IDS)

    return run


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``, as the model's own library encodes the whole text.

    Null and empty texts have no ids. Repeated rows repeat, rows without an id are kept. Bytes that are no UTF-8 count as
    replacement characters. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = PARTS * shuffle_partitions(docs)
    # one exchange, which three steps read; units stay where their part is until they have their ids
    sent = rows.mapInArrow(_sent(model.path, parts), _SENT_SQL).repartition(parts, "key")
    distinct = sent.groupBy("key").applyInArrow(_distinct, "part long, unit string").repartition(parts, "part")
    wide = 2 if max((i for _, i, _ in model.pieces), default=0) < 1 << 16 else 4
    back = sent.groupBy("key").cogroup(unit_ids(distinct, model).groupBy("part")).applyInArrow(_coded(wide), "block long, part long, n int, ids binary")
    return sent.groupBy("key").cogroup(back.groupBy("block")).applyInArrow(_joined(wide), _RESULT)


def _decoded(pieces: tuple[tuple[str, int, float], ...], bytes_from: int):
    """Texts of lists of ids, gathered from a table of the bytes of every id."""
    def run(batches):
        table = {i: p.replace(MARK, " ").encode() for p, i, _ in pieces} | {bytes_from + b: bytes([b]) for b in range(256)}
        said = [table.get(i, b"") for i in range(max(table) + 1)] + [b""]  # the last stands for ids of nothing
        long = np.fromiter(map(len, said), np.int64, len(said))
        begin, letters = np.cumsum(long) - long, np.frombuffer(b"".join(said), np.uint8)
        for batch in batches:
            texts = []
            for at in range(0, batch.num_rows, _AT_ONCE):
                lists = batch.column("ids").slice(at, _AT_ONCE)
                ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
                ids = np.where((ids < 0) | (ids >= len(said)), len(said) - 1, ids)
                each = long[ids]
                stop = np.cumsum(each)
                raw = letters[np.repeat(begin[ids] - (stop - each), each) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                edges = np.r_[0, stop][np.r_[0, np.cumsum(sizes)]].tolist()
                for first, last in zip(edges[:-1], edges[1:]):
                    text = raw[first:last].decode("utf-8", "replace")
                    texts.append(text[1:] if text.startswith(" ") else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the text that was encoded. Ids of no piece and no byte add nothing, as null does."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(model.pieces, model.bytes_from), "doc_id long, text string")


def _digested(pieces: tuple[tuple[str, int, float], ...], bytes_from: int):
    decoder = _decoded(pieces, bytes_from)

    def run(batches):
        some, same = tee(whole.slice(at, _AT_ONCE) for whole in batches for at in range(0, whole.num_rows, _AT_ONCE))
        for batch, told in zip(some, decoder(same)):
            text = binary(told.column("text"))
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.r_[0, np.cumsum(sizes)].tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes), pa.array([zlib.crc32(ids[a:e]) for a, e in zip(edges[:-1], edges[1:])], pa.int64()),
                pc.binary_length(text).cast(pa.int64()), pa.array([zlib.crc32(t.as_buffer()) for t in text], pa.int64())],
                names=["doc_id", "n_pieces", "ids_crc32", "decoded_bytes", "decoded_crc32"])
        give_back()

    return run


def digest(encoded: DataFrame, model: Model) -> DataFrame:
    """Numbers and CRC-32 of the ids (little-endian 32 bits) and of the text they decode to."""
    return encoded.mapInArrow(_digested(model.pieces, model.bytes_from),
                              "doc_id long, n_pieces long, ids_crc32 long, decoded_bytes long, decoded_crc32 long")
