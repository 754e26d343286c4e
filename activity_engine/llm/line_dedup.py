"""Drop boilerplate lines: those that stand on more than a given share of their host's pages. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_engine.session import durable

#: A line goes if more than this share of its host's pages hold it, and at least ``MIN_PAGES`` of them.
RATIO = 0.1
MIN_PAGES = 3
#: Larger tables of dropped lines are joined by host instead of being broadcast.
BROADCAST_ROWS = 100_000
NEWLINE = "\n"


def lines(text: Column) -> Column:
    """The lines of a text, empty ones too; null has none."""
    return F.split(text, NEWLINE, -1)


def _name(line: Column) -> Column:
    """Two independent 64-bit hashes of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def frequent_lines(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, pages, share) of the lines of ``docs`` (host, text) above the ratio; ``line`` is the pair of hashes.

    Empty lines never count. A page counts once for a line that it repeats. Pages without a host form a host of their own.
    """
    named = docs.select("host", F.explode(F.array_distinct(F.transform(
        F.filter(lines(F.col("text")), lambda line: F.trim(line) != ""), _name))).alias("line"))
    pages = docs.groupBy("host").agg(F.count("*").alias("total"))
    counts = named.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    # one row per host at most, and hosts are few beside pages; Spark broadcasts them only when they are small
    return (counts.join(pages, counts["host"].eqNullSafe(pages["host"])).where(F.col("pages") > ratio * F.col("total"))
            .select(counts["host"], "line", "pages", (F.col("pages") / F.col("total")).alias("share")))


def line_dedup(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host: str = "source") -> DataFrame:
    """``docs`` with all its columns, its ``text`` without frequent lines, and ``__dropped``, the number of lines dropped.

    ``host`` names the column of the site. Lines equal in every byte count as one. A text whose lines all go becomes empty
    and its row stays; null stays null. A column ``__dropped`` of the input is replaced. Repeated rows are pages of their own. An empty table gives no rows.
    """
    # the row travels as one value, so none of its columns can clash
    site = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{host}`").cast("string").alias("host"), F.col("text").alias("text"))
    found = durable(frequent_lines(site.select("host", "text"), ratio, min_pages))
    # A host's pages hold pages * lines-per-page line occurrences, and each frequent line takes ratio * pages of them:
    # there are at most lines-per-page / ratio rows per host here.
    listed = found.groupBy("host").agg(F.collect_set("line").alias("frequent")).withColumnRenamed("host", "site")
    if found.count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    joined = site.join(listed, F.col("host").eqNullSafe(F.col("site")), "left")
    some = F.col("frequent").isNotNull()
    kept = F.filter(lines(F.col("text")), lambda line: ~F.array_contains(F.col("frequent"), _name(line)))
    text = F.when(some, F.array_join(kept, NEWLINE)).otherwise(F.col("text"))
    dropped = F.when(some, F.size(lines(F.col("text"))) - F.size(kept)).otherwise(F.lit(0))
    done = joined.select("row", text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(dropped).cast("long").alias("dropped"))
    names = [n for n in docs.columns if n != "__dropped"]
    return done.select(*[F.col("text") if n == "text" else F.col("row")[n].alias(n) for n in names], F.col("dropped").alias("__dropped"))


def digest(result: DataFrame) -> DataFrame:
    """``doc_id``, lines dropped and left, and the CRC-32 and length of the text that stays."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return result.select("doc_id", F.col("__dropped").alias("n_dropped"), F.size(lines(text)).cast("long").alias("n_left"),
                         F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


SQL = f"""
WITH pages AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
 cut AS (SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM pages),
 totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
 counts AS (SELECT source, line, count(*) AS n FROM cut WHERE trim(line) <> '' GROUP BY source, line),
 frequent AS (SELECT c.source, list(c.line) AS gone FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
              WHERE n >= {MIN_PAGES} AND n > {RATIO} * total GROUP BY c.source),
 kept AS (SELECT doc_id, string_split(text, chr(10)) AS was,
            list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(gone, x), false)) AS left_
          FROM pages p LEFT JOIN frequent f ON p.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, len(was) - len(left_) AS n_dropped, greatest(len(left_), 1) AS n_left,
  length(coalesce(array_to_string(left_, chr(10)), '')) AS n_chars, md5(coalesce(array_to_string(left_, chr(10)), '')) AS text_md5
FROM kept
"""
