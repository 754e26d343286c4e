"""Photo files, and what their EXIF block says."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.functions import calendar as cal


def photos(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,png,JPG,JPEG,PNG}") -> DataFrame:
    """Images below a folder: path, file name, id (name without extension), bytes."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("filename"), F.regexp_replace(name, r"\.[^.]+$", "").alias("photo_id"), "content"
    )


_RAW = (
    "path string, taken string, lat array<double>, lat_ref string, lon array<double>, lon_ref string, problem string"
)


def _read_exif(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Original date and raw GPS of each image; nulls where an image has none, and ``problem`` where it cannot be read. Without the
    imaging library this fails."""
    from PIL import Image

    def one(content: bytes) -> tuple:
        try:
            block = Image.open(io.BytesIO(content)).getexif()
            gps = block.get_ifd(0x8825)
            taken = block.get_ifd(0x8769).get(0x9003) or block.get(0x0132)
            lat, lon = ([float(x) for x in gps[k]] if k in gps else None for k in (2, 4))
            return taken, lat, gps.get(1, "N"), lon, gps.get(3, "E"), None
        except (OSError, ValueError, TypeError, KeyError, ZeroDivisionError, SyntaxError) as error:
            return None, None, None, None, None, f"{type(error).__name__}: {error}"

    for batch in batches:
        rows = [one(c) for c in batch["content"]]
        frame = pd.DataFrame(rows, columns=["taken", "lat", "lat_ref", "lon", "lon_ref", "problem"], dtype=object)
        frame.insert(0, "path", batch["path"].to_numpy())
        yield frame


def exif(images: DataFrame) -> DataFrame:
    """Date and decimal position per image path."""
    raw = images.select("path", "content").mapInPandas(_read_exif, _RAW)
    return raw.select(
        "path", F.try_to_timestamp("taken", F.lit(cal.EXIF)).alias("exif_date"),
        cal.dms_to_decimal(F.get("lat", F.lit(0)), F.get("lat", F.lit(1)), F.get("lat", F.lit(2)), F.col("lat_ref")).alias("lat"),
        cal.dms_to_decimal(F.get("lon", F.lit(0)), F.get("lon", F.lit(1)), F.get("lon", F.lit(2)), F.col("lon_ref")).alias("lon"), "problem",
    ).withColumn("has_gps", F.col("lat").isNotNull() & F.col("lon").isNotNull())
