"""Named activity tables in a folder, written with Spark's own Parquet writer.

A table is laid out by a column that a batch can be compared with: the month its key holds, or else a bucket, a hash of the key.
An insert appends files to the months or buckets it has rows for; an upsert rewrites the buckets that its batch
changes, by Spark's dynamic partition overwrite, which puts new files in place only once all are written. A merge that was lost on
the way is simply run again. A result that replaces a whole table is written beside the old one as the next version folder,
so a reader keeps what it reads, and takes the newest folder Spark marked as complete.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from activity_engine.operators import merge
from activity_engine.session import durable

_BUCKET = re.compile(r"_bucket_(\d+)")


def with_bucket(df: DataFrame, by: Sequence[str], buckets: int) -> DataFrame:
    """``df`` with its bucket; the number of buckets is part of the column's name, so it stays that of the table."""
    return df.withColumn(f"_bucket_{buckets}", F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in by]), F.lit(buckets)).cast("int"))


class Warehouse:
    """``buckets``: how many a new table without a month gets; about its expected size over a gigabyte."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _listed(self, pattern: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        return [s.getPath() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []]

    def _versions(self, name: str) -> list[str]:
        return sorted(p.getParent().toString() for p in self._listed(f"{name}/v*/_SUCCESS"))

    def _next(self, name: str) -> str:
        """The folder after every other, those that a lost job left unfinished among them."""
        numbers = [int(p.getName()[1:]) for p in self._listed(f"{name}/v*") if p.getName()[1:].isdigit()]
        return f"{self.root}/{name}/v{max(numbers, default=0) + 1:06d}"

    def exists(self, name: str) -> bool:
        return self.read(name) is not None

    def _stored(self, name: str) -> DataFrame | None:
        """The newest version as it lies there, its bucket column included."""
        versions = self._versions(name)
        if not versions:
            return None
        try:
            return self.spark.read.parquet(versions[-1])
        except AnalysisException as error:
            # A table laid out by month or bucket holds no file, hence no schema, while it is empty.
            if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
                return None
            raise

    def read(self, name: str, columns: Sequence[str] | None = None) -> DataFrame | None:
        """The table, or None when absent. Only the asked columns that exist are read."""
        df = self._stored(name)
        if df is None:
            return None
        df = df.drop(*[c for c in df.columns if _BUCKET.fullmatch(c)])
        return df if columns is None else df.select(*[c for c in columns if c in df.columns])

    def overwrite(self, name: str, df: DataFrame) -> int:
        return self._write(df, self._next(name), "errorifexists")

    def insert_absent(
        self, name: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None,
        partition: str | None = None,
    ) -> int:
        """Append the batch rows whose key the table lacks; returns how many. Running it again adds nothing.

        ``partition`` is a calendar column (the month) that follows from the key: the table is laid out by it, and a
        batch is compared only with the months it holds. Without one, the same goes for buckets of the key.
        """
        order = list(order or [c for c in batch.columns if c not in keys])
        stored = self._stored(name)
        layout = partition or self._bucket(stored) or f"_bucket_{self.buckets}"
        if not partition:
            batch = with_bucket(batch, keys, int(_BUCKET.fullmatch(layout).group(1)))
            order = [*order, layout]
        if stored is None:
            return self._write(merge.first_per_key(batch, keys, order), self._next(name), "errorifexists", layout)
        if layout not in stored.columns:  # once replaced as a whole: laid out anew with what is added
            old = with_bucket(stored, keys, self.buckets)
            fresh = durable(merge.absent_rows(batch, old, keys, order))
            self._write(old.unionByName(fresh, allowMissingColumns=True), self._next(name), "errorifexists", layout)
            return fresh.count()
        fresh = merge.absent_rows(batch, self._beside(stored, batch, layout), keys, order)
        return self._write(fresh, self._versions(name)[-1], "append", layout)

    def upsert(self, name: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> int:
        """Replace rows of the same key, add new ones; returns the size of the table. Only buckets of the batch are rewritten."""
        order = list(order or [c for c in batch.columns if c not in keys])
        return self._merge(name, batch, keys, lambda target, rows: merge.upsert(target, rows, keys, order), merge.first_per_key(batch, keys, order))

    def replace_groups(self, name: str, batch: DataFrame, group: Sequence[str]) -> int:
        """Replace all rows of the groups that the batch holds, those it no longer has among them; returns the size of the table.
        The buckets are those of the group."""
        def merged(target: DataFrame, rows: DataFrame) -> DataFrame:
            gone = rows.select(*group).distinct()
            return target.join(gone, merge.null_safe(target, gone, group), "left_anti").unionByName(rows)

        return self._merge(name, batch, group, merged, batch)

    def _merge(self, name: str, batch: DataFrame, by: Sequence[str], merged, first: DataFrame) -> int:
        stored = self._stored(name)
        layout = self._bucket(stored) or f"_bucket_{self.buckets}"
        buckets = int(_BUCKET.fullmatch(layout).group(1))
        if stored is None:
            return self._write(with_bucket(first, by, buckets), self._next(name), "errorifexists", layout)
        rows = durable(with_bucket(batch, by, buckets))
        if layout not in stored.columns:
            return self._write(merged(with_bucket(stored, by, buckets), rows), self._next(name), "errorifexists", layout)
        held = durable(merged(self._beside(stored, rows, layout), rows))  # settled before what it was read from is replaced
        self._write(held, self._versions(name)[-1], "overwrite", layout)
        return self.read(name).count()

    @staticmethod
    def _bucket(stored: DataFrame | None) -> str | None:
        return next((c for c in stored.columns if _BUCKET.fullmatch(c)), None) if stored is not None else None

    @staticmethod
    def _beside(stored: DataFrame, batch: DataFrame, layout: str) -> DataFrame:
        """The rows of the months or buckets that the batch has: folders, so no other is read."""
        wanted = [row[0] for row in batch.select(layout).distinct().collect()]
        inside = F.col(layout).isin(*[m for m in wanted if m is not None])
        return stored.filter(inside | F.col(layout).isNull() if None in wanted else inside)

    @staticmethod
    def _write(df: DataFrame, path: str, mode: str, partition: str | None = None) -> int:
        """Rows are counted while they are written, not by a second scan. Rows of one folder come together, and a folder with
        many rows is still written by several tasks."""
        seen = Observation()
        together = df.hint("rebalance", partition) if partition else df
        writer = together.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
        if partition:
            writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
        writer.parquet(path)
        return seen.get["rows"]

    def export_json(self, df: DataFrame, folder: str) -> None:
        df.write.mode("overwrite").json(f"{self.root}/{folder}")

    def export_text(self, df: DataFrame, folder: str) -> None:
        df.write.mode("overwrite").text(f"{self.root}/{folder}")

    def export_csv(self, df: DataFrame, folder: str) -> None:
        df.write.mode("overwrite").option("header", True).csv(f"{self.root}/{folder}")


def resolve_columns(columns: Sequence[str], roles: dict[str, Sequence[str]]) -> dict[str, str] | None:
    """First existing column for each role, None when a role has none (the feature is then left out)."""
    found = {role: next((c for c in names if c in columns), None) for role, names in roles.items()}
    return None if None in found.values() else found


# Column names under which play tables are known.
PLAY_ROLES = {
    "timestamp": ("stream_ts", "played_at", "ts", "listen_ts"),
    "track_id": ("track_id", "trackId", "spotify_track_uri", "trackUri"),
    "track_name": ("track_name", "trackName", "master_metadata_track_name"),
    "artist": ("artist_name", "artistName", "master_metadata_album_artist_name"),
}
