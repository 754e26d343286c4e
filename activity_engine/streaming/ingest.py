"""Incremental ingestion: new export files are merged into a table once, as they are found."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from activity_engine.warehouse import Warehouse


def ingest(
    files: DataFrame, warehouse: Warehouse, table: str, keys: Sequence[str], checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    """Merge everything a file stream has not delivered yet, then stop.

    The merge inserts only absent keys, so a batch that is repeated after a failure adds nothing twice.
    """
    def merge(batch: DataFrame, _: int) -> None:
        warehouse.insert_absent(table, prepare(batch), keys)

    return (
        files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
