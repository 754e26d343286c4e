"""One query per operator, over its whole table and with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from activity_engine.llm import (
    decontamination, line_dedup, mixing, neighbours, ngram_join, pieces, quality, resampling, sharding, substring_dedup, token_files,
    vector_codes, warc,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(_table(spark, folder, "documents")))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = pieces.Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.digest(pieces.encode(_table(spark, folder, "documents"), model), model)


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.score_texts(_table(spark, folder, "documents"))


def op4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.digest(sharding.shard_by_bytes(_table(spark, folder, "documents")))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.digest(quality.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels")))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(_table(spark, folder, "documents")))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    where = token_files.shared_folder(spark, "token-files")
    token_files.write_tokens(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), where)
    return token_files.token_index(spark, where)


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.digest(resampling.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, _ = vector_codes.compress(_table(spark, folder, "embeddings"))
    return vector_codes.digest(coded)


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    where = token_files.shared_folder(spark, "warc")
    warc.write_warc(_table(spark, folder, "pages"), where)
    return warc.digest(warc.read_warc(spark, where, payload=False))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_sentencepiece, op3_lm_scoring, op4_nearest, op5_sharding, op6_quality, op7_decontamination, op8_ngram_join,
                            op9_line_dedup, op10_token_files, op11_importance_resampling, op12_vector_codes, op13_warc)}
SQL: dict[str, str] = {"op9_line_dedup": line_dedup.SQL, "op12_vector_codes": vector_codes.SQL, "op13_warc": warc.SQL}
