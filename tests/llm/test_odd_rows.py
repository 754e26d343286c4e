"""Cases that broke operators before: only empty texts, clashing names, rows without an id, vectors of several lengths."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from activity_engine.llm import line_dedup, neighbours, ngram_join, quality, resampling, substring_dedup, words

CLASHES = ["site", "path", "__site", "__path", "__score", "junk_shift", "toxic_rate", "__host", "__frequent", "__dropped", "row", "host", "score", "junk",
           "__junk", "__keep", "own_site", "frequent", "line", "pages"]


def test_words_of_only_empty_texts_in_a_new_process(monkeypatch):
    monkeypatch.setattr(words, "_POWERS", {})
    cut = words.cut(pa.array([b"", b" \n"], pa.binary()))
    assert len(cut.hashes) == 0 and cut.first.tolist() == [0, 0, 0] and len(cut.grams(5)) == 0


def test_only_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, "a", "b"), (2, "", "a", None), (3, " \n\t", None, "b")], "doc_id long, text string, source string, lang string").repartition(2)
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.digest(substring_dedup.substring_dedup(docs)).collect()) == [(1, 0, 0), (2, 0, 0), (3, 0, 0)]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, labels).count() == 3
    assert resampling.resample(docs, docs).where("n_features = 0 and weight = 0 and rank is null").count() == 3


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"menu\nown line {i}" + " bad" * (i % 2), "s", "p") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return docs.select("*", *[F.lit(f"mine {i}").alias(c) for i, c in enumerate(CLASHES)])


def test_line_dedup_keeps_clashing_columns(clashing):
    found = line_dedup.line_dedup(clashing)
    assert found.columns == [c for c in clashing.columns if c != "__dropped"] + ["__dropped"]
    for r in found.collect():
        assert r["text"].startswith("own line") and r["__dropped"] == 1
        assert all(r[c] == f"mine {i}" for i, c in enumerate(CLASHES) if c != "__dropped")


def test_judge_keeps_clashing_columns(clashing):
    labels = clashing.select("doc_id", F.col("doc_id").cast("int") % 2, F.lit(0)).toDF("doc_id", "quality", "toxic")
    found = quality.judge(clashing, labels)
    made = ["__junk", "__toxic", "__junk_rate", "__toxic_rate", "__keep"]
    assert found.columns == [c for c in clashing.columns if c not in made] + made
    for r in found.collect():
        assert isinstance(r["__keep"], bool) and all(r[c] == f"mine {i}" for i, c in enumerate(CLASHES) if c not in made)


def test_rows_without_an_id_have_their_sets(spark):
    text = "a b c d e f g a b c d e"
    docs = spark.createDataFrame([(None, text), (None, None), (4, text), (9, text), (None, "x")], "doc_id long, text string")
    found = sorted((tuple(r) for r in ngram_join.ngram_components(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert found == sorted([(4, 7, 4), (9, 7, 4), (None, 7, None), (None, 0, None), (None, 1, None)], key=str)


def test_vectors_of_several_lengths_and_magnitudes(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)] + [(i, rng.normal(size=5).tolist()) for i in range(150, 155)]
    rows += [(200, (rng.normal(size=4) * 1e300).tolist()), (250, (rng.normal(size=4) * 1e-300).tolist()), (300, [1.])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by_id = dict(rows)
    unit = lambda v: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
    for q in (0, 50, 100, 150, 200, 250, 300):
        others = sorted((-float(unit(by_id[q]) @ unit(v)), i) for i, v in rows if i != q and len(v) == len(by_id[q]))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [m[1] for m in mine] == [i for _, i in others] and all(math.isclose(m[2], -s, abs_tol=1e-9) for m, (s, _) in zip(mine, others))
