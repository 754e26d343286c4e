"""A training corpus from ``documents``: stages that each apply one operator to all that the stage before kept.

Every stage but the last returns the columns of ``documents``. Empty tables pass through all stages. Rows without an id are
judged and cleaned like others, but cannot be linked to other documents or to benchmark items, and stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from activity_engine.llm import decontamination, line_dedup, ngram_join, pieces, quality, token_files


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely junk or toxic go."""
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("__keep").select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many pages of a source go; every document stays, an emptied one with an empty text."""
    return line_dedup.line_dedup(docs).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similar word n-grams connect, the one with the least id stays; of rows with one id, one."""
    groups = ngram_join.ngram_components(docs)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    apart = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    first = F.row_number().over(Window.partitionBy("doc_id", apart).orderBy("text"))
    return kept.withColumn("__row", first).where("doc_id is null or __row = 1").select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark, edited or not, go."""
    found = decontamination.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces) of every document."""
    model = pieces.Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode(docs, model).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("SentencePiece encoding", encoded),
]
#: The classifier is fitted, and merges are folded: SQL says neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder and read again, so that no stage is computed twice and what one kept is
    what the next one sees."""
    where = token_files.shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{number}")
        docs = spark.read.parquet(f"{where}/{number}")
    return docs
