"""Records of large JSON documents, read by many tasks.

A document is one value, so its records have no line ends to split at. Spark's text reader splits it anyway, at every ``}``, in as many
blocks as the file has splits; what a block means depends on whether it begins inside a string and how many brackets are
open there. A first pass finds for each block how it changes both, for either beginning: the number of quotes, and the brackets
outside strings if it begins outside or inside one. Sums over the blocks before tell every block its beginning; a second pass cuts
the records, and the pieces of those that cross a border are put together. Any store that Spark reads will do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from activity_engine.session import durable

_PAIR = re.compile(rb"\\.", re.S)
_REST_OF_STRING = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*+"?|[{}\[\]]', re.S)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], bytes, dict]]:
    """((path, block), bytes, first row) of neighbouring rows of one block."""
    paths, blocks = batch.column("path").to_pylist(), batch.column("block").to_pylist()
    values = batch.column("value").cast(pa.binary())
    start = 0
    while start < len(paths):
        end = start
        while end < len(paths) and blocks[end] == blocks[start] and paths[end] == paths[start]:
            end += 1
        some = values.slice(start, end - start).to_pylist()
        yield (paths[start], blocks[start]), b"}".join(some) + b"}", {c: batch.column(c)[start].as_py() for c in batch.schema.names if c != "value"}
        start = end


def _brackets(parts: list[bytes]) -> int:
    text = b"".join(parts)
    return text.count(b"{") + text.count(b"[") - text.count(b"}") - text.count(b"]")


def block_change(data: bytes, quotes: int) -> tuple[int, int, int]:
    """(quotes, brackets if the block begins outside a string, if inside) of bytes that follow ``quotes`` earlier ones."""
    parts = _PAIR.sub(b"", data).split(b'"')
    even, odd = _brackets(parts[0::2]), _brackets(parts[1::2])
    return len(parts) - 1, *((even, odd) if quotes % 2 == 0 else (odd, even))


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list[int]] = {}
    for batch in batches:
        for where, data, _ in _runs(batch):
            told = held.setdefault(where, [0, 0, 0])
            for i, x in enumerate(block_change(data, told[0])):
                told[i] += x
    if held:
        rows = [(*where, *told) for where, told in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "block", "quotes", "outside", "inside"])


class Cutter:
    """Cuts the records of one block: objects that begin where ``level`` brackets are open. Pieces are (kind, number of
    records begun so far in the block, key, bytes); kinds are whole, head (of a record begun before) and tail (not ended here)."""

    def __init__(self, level: int, depth: int, in_string: bool):
        self.level, self.depth, self.in_string = level, depth, in_string
        self.begun, self.key = 0, None
        self.open_: list[bytes] | None = [] if depth > level else None
        self.name = b""

    def _piece(self, data: bytes) -> tuple:
        text = b"".join([*self.open_, data])
        self.open_ = None
        return ("whole" if self.begun else "head", self.begun, self.key, text)

    def feed(self, data: bytes) -> Iterator[tuple]:
        at = 0
        if self.in_string:
            rest = _REST_OF_STRING.match(data)
            if not rest:
                if self.open_ is not None:
                    self.open_.append(data)
                return
            at, self.in_string = rest.end(), False
        start = 0
        for token in _TOKEN.finditer(data, at):
            mark = token.group()
            if mark[0] == 0x22:
                self.in_string = len(mark) == 1 or _REST_OF_STRING.fullmatch(mark, 1) is None
                self.name = mark
            elif mark in b"{[":
                if self.depth == self.level and mark == b"{" and self.open_ is None:
                    self.begun, self.open_, start = self.begun + 1, [], token.start()
                elif self.depth == self.level - 1 and mark == b"[":
                    self.key = self.name[1:-1].decode("utf-8", "replace")
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == self.level and self.open_ is not None and mark == b"}":
                    yield self._piece(data[start: token.end()])
        if self.open_ is not None:
            self.open_.append(data[start:])

    def end(self) -> Iterator[tuple]:
        if self.open_ is not None:
            yield ("tail" if self.begun else "head", self.begun, self.key, b"".join(self.open_))
        yield ("begun", self.begun, self.key, b"")


_PIECES = "path string, block long, kind string, number long, key string, text string"


def _cut(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, here = None, None

        def made(pieces) -> Iterator[pa.RecordBatch]:
            rows = [(*here, kind, number, key, text.decode("utf-8", "replace")) for kind, number, key, text in pieces]
            if rows:
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _PIECES.split(", ")])

        for batch in batches:
            for where, data, first in _runs(batch):
                if where != here:
                    if cutter:
                        yield from made(cutter.end())
                    cutter, here = Cutter(level, first["depth"], first["quotes_before"] % 2 == 1), where
                yield from made(cutter.feed(data))
        if cutter:
            yield from made(cutter.end())

    return run


def json_records(spark: SparkSession, paths: str | Sequence[str], level: int = 1, key: str | None = None) -> DataFrame:
    """(path, key, number, record) of the objects of JSON documents that stand inside ``level`` brackets: 1 for the elements of an
    outermost array, 2 for those of arrays inside an outermost object, where ``key`` names the wanted array (all, if not
    given). Text around the document, as of an assignment, does not matter. A record without an end comes as far as it goes."""
    block = F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.option("lineSep", "}").text(paths).select("value", F.col("_metadata.file_path").alias("path"), block)
    changes = durable(lines.mapInArrow(_changes, "path string, block long, quotes long, outside long, inside long"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of a file
    told = changes.withColumn("quotes_before", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    told = told.withColumn("change", F.when(F.col("quotes_before") % 2 == 0, F.col("outside")).otherwise(F.col("inside")))
    told = told.select("path", "block", "quotes_before", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"))
    # a row for each split, so a millionth of the text
    pieces = durable(lines.join(F.broadcast(told), ["path", "block"]).mapInArrow(_cut(level), _PIECES))

    counts = pieces.where("kind = 'begun'").withColumn("begun_before", F.coalesce(F.sum("number").over(before), F.lit(0))).withColumn(
        "key_before", F.last("key", ignorenulls=True).over(before)).select("path", "block", "begun_before", "key_before")
    placed = pieces.where("kind <> 'begun'").join(F.broadcast(counts), ["path", "block"]).select(
        "path", "block", "kind", (F.col("begun_before") + F.col("number")).alias("number"), F.coalesce("key", "key_before").alias("key"), "text")
    whole = placed.where("kind = 'whole'").select("path", "key", "number", F.col("text").alias("record"))
    parts = placed.where("kind <> 'whole' and number > 0").groupBy("path", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "key", "text"))).alias("parts"))
    joined = parts.select("path", F.col("parts")[0]["key"].alias("key"), "number", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("record"))
    found = whole.unionByName(joined)
    return found if key is None else found.where(F.col("key") == key)


def json_rows(spark: SparkSession, paths: str | Sequence[str], schema: str, level: int = 1, key: str | None = None) -> DataFrame:
    """The records as rows of ``schema``; what is no valid object is left out."""
    parsed = json_records(spark, paths, level, key).select(F.from_json("record", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("e"))
    return parsed.where("e is not null").select("e.*")
