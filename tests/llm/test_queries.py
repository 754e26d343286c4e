"""The registered queries on the smallest tables: SQL where there is some, whole results everywhere, and the pipeline's rows."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from activity_engine.llm import decontamination, ngram_join, pieces, quality
from activity_engine.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    base = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        base.execute(f"create view {path.stem} as select * from '{path}'")
    theirs = base.execute(f"select columns(*) from ({SQL[name]})")
    columns = sorted(c[0] for c in theirs.description)
    expected = base.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    ours = QUERIES[name](spark, FOLDER)
    assert sorted(ours.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in ours.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] in ("op1", "op2", "op3", "op5", "op6", "op8", "op9", "op10", "op11")])
def test_one_row_for_each_document(spark, name):
    ids = [r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in QUERIES[name](spark, FOLDER).select("doc_id").collect()) == sorted(ids)


def test_pipeline_step_by_step(spark):
    """Each stage keeps what its operator says, on all that the stage before kept; the last one encodes the rest."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, FOLDER).cache()
    kept = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).where("__keep").collect()}
    assert {r.doc_id for r in good.collect()} == kept and good.columns == docs.columns
    clean = stages["line dedup"](spark, good, FOLDER).cache()
    assert {r.doc_id for r in clean.collect()} == kept and clean.columns == docs.columns
    groups = ngram_join.ngram_components(clean).collect()
    alone = stages["n-gram Jaccard join"](spark, clean, FOLDER).cache()
    assert sorted(r.doc_id for r in alone.collect()) == sorted({r.component_id for r in groups}) and alone.columns == docs.columns
    found = {r.doc_id for r in decontamination.find_items(alone, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    rest = stages["benchmark decontamination"](spark, alone, FOLDER).cache()
    assert {r.doc_id for r in rest.collect()} == {r.component_id for r in groups} - found and rest.columns == docs.columns
    coded = stages["SentencePiece encoding"](spark, rest, FOLDER)
    import public_tokenizers

    model = pieces.Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(map(tuple, pieces.decode(coded, model).collect())) == sorted((r.doc_id, r.text) for r in rest.collect())
    assert [name for name, _ in corpus_pipeline.STAGES] == list(stages)


def test_entry_lists_them():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
