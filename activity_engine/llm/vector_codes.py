"""Vectors as short codes: each of eight parts is named by the nearest of sixteen entries of that part's codebook.

A block holds some thousand vectors of one length by dimension: the distinct integers of the dimension, and each vector's place
among them. The squared differences of those few integers to all entries are tabulated once for a block and round; the
distance of a part is then a sum of rows gathered from the tables, and the sums behind new entries follow from counts of
(place, entry). Blocks are written once and read in every round; only codebooks and their sums pass through the driver.

Integers beyond +-2**60 count as that. Where they or their squares need more than 64 bits, blocks use Python's integers, and an
error that no long can hold is given as the greatest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from activity_engine.llm.hot import attach
from activity_engine.session import durable

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components of a block, and its rows at most, so that a place takes two bytes.
BLOCK, MOST_ROWS = 1 << 21, 1 << 16
LARGEST = 1 << 60
MOST = (1 << 63) - 1
BLOCKS = "size int, ids array<long>, labels array<string>, counts array<int>, integers array<long>, places binary"
_BLOCKS = pa.schema([("size", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())),
                     ("counts", pa.list_(pa.int32())), ("integers", pa.list_(pa.int64())), ("places", pa.binary())])

Book = np.ndarray  #: entries x components, of integers


def integers(values: np.ndarray) -> np.ndarray:
    """floor(4096 * x), from -2**60 to 2**60."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def bounds(size: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and its end; lengths that do not divide give parts that differ by one."""
    return [i * size // parts for i in range(parts + 1)]


def _pack(size: int, ids: list, labels: list, rows: np.ndarray) -> pa.RecordBatch:
    found, places = [], np.empty(rows.T.shape, "<u2")
    for d in range(size):
        distinct, places[d] = np.unique(rows[:, d], return_inverse=True)
        found.append(distinct)
    row = [size, ids, labels, [len(x) for x in found], np.concatenate(found) if found else [], places.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCKS)], schema=_BLOCKS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        vectors = batch.column("vector")
        lengths = np.diff(vectors.offsets.to_numpy())
        flat = integers(vectors.flatten().to_numpy(zero_copy_only=False))
        begin = np.cumsum(lengths) - lengths
        ids, labels = batch.column("id").to_pylist(), batch.column("label").to_pylist()
        for size in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == size)
            rows = flat[begin[mine][:, None] + np.arange(size)]
            h = held.setdefault(size, [[], [], []])
            h[0] += [ids[i] for i in mine]
            h[1] += [labels[i] for i in mine]
            h[2].append(rows)
            most = max(1, min(MOST_ROWS, BLOCK // max(size, 1)))
            if len(h[0]) >= most:
                rows = np.concatenate(h[2])
                whole = len(rows) // most * most
                for a in range(0, whole, most):
                    yield _pack(size, h[0][a: a + most], h[1][a: a + most], rows[a: a + most])
                held[size] = [h[0][whole:], h[1][whole:], [rows[whole:]]]
    for size, (ids, labels, rows) in held.items():
        if ids:
            yield _pack(size, ids, labels, np.concatenate(rows))


class Block:
    """A block of vectors by dimension: ``integers[d]`` are the distinct ones, ``places[d]`` says which each vector has."""

    def __init__(self, row: dict, book: Book):
        self.size, self.n = row["size"], len(row["ids"])
        every = np.array(row["integers"], np.int64)
        span = (max(map(abs, (int(every.min()), int(every.max())))) if len(every) else 0) + int(max(map(abs, book.flat), default=0))
        kind = np.int64 if span * span * max(self.size, 1) < 1 << 63 and span * self.n < 1 << 63 else object
        self.integers = np.split(every.astype(kind), np.cumsum(row["counts"])[:-1]) if self.size else []
        self.places = np.frombuffer(row["places"], "<u2").reshape(self.size, self.n)
        self.book, self.kind = book.astype(kind), kind

    def nearest(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry (the least, where several are) of components ``start`` to ``end``, and its squared distance."""
        total = np.zeros((self.n, len(self.book)), self.kind)
        for d in range(start, end):
            table = (self.integers[d][:, None] - self.book[None, :, d]) ** 2
            total += table[self.places[d]]
        best = total.argmin(axis=1)
        return best, total[np.arange(self.n), best]

    def sums(self, d: int, best: np.ndarray) -> np.ndarray:
        """The sum of component ``d`` over the vectors of each entry."""
        entries, distinct = len(self.book), len(self.integers[d])
        pairs = np.bincount(self.places[d].astype(np.int64) * entries + best, minlength=distinct * entries)
        return self.integers[d] @ pairs.reshape(distinct, entries).astype(self.kind)


def _totals(books: dict[int, Book]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                size, book = row["size"], books[row["size"]]
                block, edge = Block(row, book), bounds(row["size"])
                n = counts.setdefault(size, np.zeros((size, len(book)), np.int64))
                total = sums.setdefault(size, np.zeros((size, len(book)), object))
                for start, end in zip(edge, edge[1:]):
                    best, _ = block.nearest(start, end)
                    n[start:end] += np.bincount(best, minlength=len(book))
                    for d in range(start, end):
                        total[d] += block.sums(d, best)
        for size, n in counts.items():
            used = np.argwhere(n > 0)
            yield pa.RecordBatch.from_arrays([
                pa.array([size] * len(used), pa.int32()), pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()),
                pa.array(n[n > 0], pa.int64()), pa.array([Decimal(int(x)) for x in sums[size][n > 0]], pa.decimal128(38, 0))],
                names=["size", "place", "entry", "n", "total"])

    return run


def book_digest(book: Book) -> str:
    """SHA-256 of all entries' integers by part, entry and place, joined by commas."""
    edge = bounds(book.shape[1])
    told = (str(int(x)) for a, e in zip(edge, edge[1:]) for entry in book for x in entry[a:e])
    return hashlib.sha256(",".join(told).encode()).hexdigest()


_CODED = pa.schema([("id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64()), ("codebooks_sha256", pa.string())])


def _code(books: dict[int, Book]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = {size: book_digest(book) for size, book in books.items()}
        for batch in batches:
            for row in batch.to_pylist():
                block, edge = Block(row, books[row["size"]]), bounds(row["size"])
                codes, error = np.empty((block.n, PARTS), np.uint8), np.zeros(block.n, block.kind)
                for part, (start, end) in enumerate(zip(edge, edge[1:])):
                    codes[:, part], far = block.nearest(start, end)
                    error += far
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()),
                    pa.array([text[i: i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]),
                    pa.array([min(int(x), MOST) for x in error], pa.int64()),
                    pa.array([digests[row["size"]]] * block.n)], schema=_CODED)

    return run


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, dict[int, Book]]:
    """(id, label, code, error, codebooks_sha256) of every vector, and the codebooks by vector length.

    Rows whose vector is null, or holds null or a component that is not finite, are left out. Each length has codebooks of
    its own. They begin with the vectors of the 16 smallest ids, null last, equal ids by their components, and there are
    fewer entries where there are fewer vectors. Repeated rows count repeatedly. ``label`` comes back as text.
    """
    kept = vectors.where(F.col(vector).isNotNull()).select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    kept = kept.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    blocks = durable(kept.mapInArrow(_blocks, BLOCKS))
    first = F.row_number().over(Window.partitionBy("size").orderBy(F.col("id").asc_nulls_last(), "vector"))
    begun = kept.withColumn("size", F.size("vector")).withColumn("n", first).where(F.col("n") <= ENTRIES).collect()
    books = {
        size: np.array([integers(np.array(r.vector, np.float64)) for r in sorted(begun, key=lambda r: r.n) if r["size"] == size], object)
        for size in {r["size"] for r in begun}}
    for _ in range(ROUNDS if books else 0):
        sums = (blocks.mapInArrow(_totals(books), "size int, place int, entry int, n long, total decimal(38,0)")
                .groupBy("size", "place", "entry").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
        books = {size: book.copy() for size, book in books.items()}
        for r in sums.collect():  # at most an entry's components for every codebook
            books[r["size"]][r.entry, r.place] = int(r.total) // r.n
    return blocks.mapInArrow(_code(books), "id long, label string, code string, error long, codebooks_sha256 string"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``label_error``: errors summed over rows with the same label; null is a label of its own."""
    key = F.when(F.col("label").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "label"))
    held = durable(coded.withColumn("__label", key))
    capped = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(MOST))).cast("long")
    totals = held.groupBy("__label").agg(F.count(F.lit(1)).alias("__rows"), capped.alias("label_error"))
    return attach(held, totals, "__label", "__rows", F.xxhash64("id", "code", "error")).drop("__label", "__rows")


def digest(coded: DataFrame) -> DataFrame:
    return with_label_errors(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """All rounds as a chain of tables; vectors of one length, a multiple of eight."""
    rounds = []
    for k in range(ROUNDS + 1):
        rounds.append(f"""
near{k} as materialized (
  select vec_id, part, entry, dist from (
    select c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) as dist
    from cells c join book{k} b on c.part = b.part and c.place = b.place group by all)
  qualify row_number() over (partition by vec_id, part order by dist, entry) = 1),""")
        if k < ROUNDS:
            rounds.append(f"""
book{k + 1} as materialized (
  select b.part, b.entry, b.place, coalesce(m.x, b.x) as x from book{k} b left join (
    select c.part, n.entry, c.place, floor(sum(c.x)::double / count(*))::bigint as x
    from cells c join near{k} n on c.vec_id = n.vec_id and c.part = n.part group by all) m
  on b.part = m.part and b.entry = m.entry and b.place = m.place),""")
    return f"""
with kept as materialized (
  select vec_id, label, embedding, len(embedding) // {PARTS} as width from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cells as materialized (
  select vec_id, d // width as part, d % width as place, floor({SCALE} * f::double)::bigint as x
  from (select vec_id, width, unnest(range(len(embedding))) as d, unnest(embedding) as f from kept)),
firsts as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {ENTRIES}),
book0 as materialized (select part, entry, place, x from cells join firsts using (vec_id)),{"".join(rounds)}
told as (select sha256(string_agg(x::varchar, ',' order by part, entry, place)) as codebooks_sha256 from book{ROUNDS}),
coded as (
  select vec_id, string_agg(printf('%02x', entry::int), '' order by part) as code, sum(dist)::bigint as error
  from near{ROUNDS} group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join kept using (vec_id) cross join told
"""


SQL = _sql()
