"""Documents dealt into even blocks by a hash of their id, and keys that several blocks share.

A task that knows all documents of a block can send one row per block and key, and can be sent back what it needs to
know about its own keys. A key therefore never has more rows than there are blocks, however many documents hold it.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Between the phases of a long job: Spark deletes shuffle files only once the driver's JVM has found that no plan needs
    them any more, which may take it half an hour by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dealt(docs: DataFrame, *columns: str, per_partition: float = 2) -> DataFrame:
    """``doc_id``, ``text`` as bytes, other columns, and ``block``: ``per_partition`` blocks for a shuffle partition.
    The block follows the id, and the text where ids are missing or repeated many times."""
    count = max(1, round(shuffle_partitions(docs) * per_partition))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *columns,
        F.pmod(F.hash("doc_id", "text"), F.lit(count)).alias("block"))


def _as_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False)
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0, True]) if len(block) else np.zeros(1, np.int64)
        held = batch.drop_columns(["block"])
        texts = [_as_bytes(held.take(pa.array(order[a:e]))) for a, e in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(block[order[edges[:-1]]], pa.int32()), pa.array(texts, pa.binary())], names=["block", "texts"])


def packed(docs: DataFrame, per_partition: float = 2) -> DataFrame:
    """(block, texts): as ``dealt``, the documents of each block in a batch compressed together, for less to shuffle."""
    return dealt(docs, per_partition=per_partition).mapInArrow(_pack, "block int, texts binary")


def opened(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The documents (doc_id, text) of one block of ``packed``, some at a time."""
    for texts in table.column("texts"):
        yield from pa.ipc.open_stream(texts.as_buffer())


def recurring(keys: DataFrame) -> DataFrame:
    """Rows (key, block, lo, hi), one per key and block, with ids from lo to hi: (block, key, owner) of those keys that
    several ids have, the least of which is the ``owner``."""
    over = Window.partitionBy("key")
    told = keys.withColumn("owner", F.min("lo").over(over)).withColumn("last", F.max("hi").over(over))
    return told.where("owner < last").select("block", "key", "owner")


def repeated(keys: DataFrame) -> DataFrame:
    """As ``recurring``, but only for blocks that hold an id larger than the owner."""
    told = keys.withColumn("owner", F.min("lo").over(Window.partitionBy("key")))
    return told.where("owner < hi").select("block", "key", "owner")
