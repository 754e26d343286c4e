"""Export folders as a table: which platform a file belongs to, where it goes, which copy stays, what is wrong."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.operators.merge import surviving_versions

# Folder-name patterns and the platform they stand for.
FOLDER_PATTERNS = {
    "INSTAGRAM": r"(?i)^instagram",
    "GOOGLE": r"(?i)^takeout",
    "TIKTOK": r"(?i)^tiktok",
    "X": r"(?i)^twitter",
    "SPOTIFY": r"(?i)^spotify",
}
# A later export replaces the earlier one only where exports are complete each time.
LATEST_WINS = {"INSTAGRAM": False, "GOOGLE": False, "TIKTOK": True, "X": True, "SPOTIFY": False, "NETFLIX": True}
# Extensions a folder must have at least one of.
EXTENSIONS = {
    "INSTAGRAM": [".json"], "GOOGLE": [".html", ".json"], "TIKTOK": [".json"], "X": [".js", ".html"],
    "SPOTIFY": [".json"], "NETFLIX": [".csv"],
}
FILM_FILE = "NetflixViewingHistory.csv"


def source_of(folder: Column, patterns: Mapping[str, str] = FOLDER_PATTERNS) -> Column:
    source = F.lit(None).cast("string")
    for name, pattern in reversed(list(patterns.items())):
        source = F.when(folder.rlike(pattern), F.lit(name)).otherwise(source)
    return source


def target_path(source: Column, folder: Column, inside: Column) -> Column:
    """Where a file goes below its platform: the archive's own root folder is dropped, music exports are split in two."""
    music = F.when(F.lower(folder).contains("account data"), "account").when(
        F.lower(folder).contains("extended streaming"), "extended").otherwise("account")
    return (
        F.when(source == "GOOGLE", F.regexp_replace(inside, "^Takeout/", ""))
        .when(source == "SPOTIFY", F.concat(music, F.lit("/"), inside))
        .otherwise(inside)
    )


def _path(column: str) -> Column:
    """Path of a file name without scheme and percent escapes."""
    plain = F.regexp_replace(column, "^[a-z0-9]+:(//[^/]*(?=/))?", "")
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def scan(spark: SparkSession, inbox: str) -> DataFrame:
    """One row per file below the inbox: folder, path inside it, size, time. Contents are not read.

    A scan leaves empty files out, so the sizes are joined to the file names Spark lists for any source.
    """
    scanned = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(inbox)
    sizes = scanned.select(_path("path").alias("_key"), "length", "modificationTime")
    names = spark.createDataFrame([(name,) for name in scanned.inputFiles()], "path string")
    files = names.withColumn("_key", _path("path")).join(sizes, "_key", "left").na.fill(0, ["length"])
    root = spark._jvm.org.apache.hadoop.fs.Path(inbox)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    inside = F.substring("_key", len(base) + 1, 1 << 20)
    listed = files.select("path", inside.alias("_inside"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    in_folder = F.col("_inside").contains("/")
    folder = F.when(in_folder, F.substring_index("_inside", "/", 1)).otherwise(F.lit(""))
    name = F.regexp_replace("_inside", "^[^/]*/", "")
    found = listed.withColumns({"folder": folder, "inside": F.when(in_folder, name).otherwise(F.col("_inside"))})
    source = F.when(in_folder, source_of(F.col("folder"))).when(F.col("_inside") == FILM_FILE, "NETFLIX")
    known = found.withColumn("source", source).filter(F.col("source").isNotNull())
    return known.withColumn("target", target_path(F.col("source"), F.col("folder"), F.col("inside"))).drop("_inside")


def choose(files: DataFrame) -> DataFrame:
    """The file that stays for each (source, target), by the order of the export folders."""
    latest = F.lit(False)
    for name, wins in LATEST_WINS.items():
        latest = F.when(F.col("source") == name, F.lit(wins)).otherwise(latest)
    flagged = files.withColumn("_latest", latest)
    order = _folder_number(files)
    return surviving_versions(
        flagged.join(order, ["source", "folder"]), ["source", "target"], "_seq", "_latest", "path"
    ).drop("_latest", "_seq")


def _folder_number(files: DataFrame) -> DataFrame:
    """Position of an export folder among those of its platform (a person has a handful of them)."""
    from activity_engine.operators.ordered import dense_position

    return dense_position(files.select("source", "folder").distinct(), ["source"], ["folder"], "_seq")


def findings(files: DataFrame) -> DataFrame:
    """Problems per folder: no file of an expected type (warning), an empty file (error)."""
    extension = F.lower(F.regexp_extract("inside", r"(\.[^./]+)$", 1))
    expected = F.lit(False)
    for name, kinds in EXTENSIONS.items():
        expected = F.when(F.col("source") == name, extension.isin(*kinds)).otherwise(expected)
    checked = files.groupBy("source", "folder").agg(
        F.count("*").alias("files"), F.bool_or(expected).alias("_known"), F.count_if(F.col("size") == 0).alias("_empty")
    )
    problems = F.array_compact(F.array(
        F.when(~F.col("_known"), F.struct(F.lit("warning").alias("level"), F.lit("no expected extension").alias("problem"))),
        F.when(F.col("_empty") > 0, F.struct(F.lit("error").alias("level"), F.lit("empty file").alias("problem"))),
    ))
    return checked.withColumn("_p", F.explode(problems)).select("source", "folder", "files", "_p.level", "_p.problem")
