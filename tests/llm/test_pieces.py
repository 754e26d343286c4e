"""How texts are cut into units and numbered, and that they are read once."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from activity_engine.llm import pieces, words

TEXTS = ["one two one", "", " lead", "trail ", "a  b", "line\nnext\n\nend \x01", "\n", "mark ▁ here", "x" * 70 + " one", "ré one\tré", " ", "two\n two"]


def test_numbered_units_are_those_of_the_texts():
    for texts in ([t.encode() for t in TEXTS], [b"one", b"\xff\xfe two  \xe2"], []):
        found, part, numbers, sizes = pieces._dealt(pa.array(texts, pa.binary()), 5)
        held, cuts = [u.decode() for u in found.to_pylist()], np.split(numbers, np.cumsum(sizes))
        assert [[held[i] for i in cut] for cut in cuts[:-1]] == [pieces.units(t.decode("utf-8", "replace")) for t in texts]
        assert len(set(held)) == len(held) and all((p == 5) == (len(u) > pieces.LONGEST) for p, u in zip(part.tolist(), held))


def test_texts_are_cut_once(spark):
    """Texts that differ whenever they are computed: an error when they were read once for units and once for numbers."""
    model = pieces.Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("text", F.concat_ws(" ", "text", F.uuid()))
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, model), model).collect()}
    assert [back[i][:-36] for i in range(len(TEXTS))] == [t.replace("▁", " ") + " " for t in TEXTS]


def test_equal_batches_of_texts(spark):
    """Batches of the same ids and texts have one name."""
    model = pieces.Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    one = spark.createDataFrame([(1, "one two"), (2, "y" * 80)], "doc_id long, text string").coalesce(1)
    want = sorted((r.doc_id, r.ids) for r in pieces.encode(one, model).collect())
    assert sorted((r.doc_id, r.ids) for r in pieces.encode(one.union(one), model).collect()) == sorted([*want, *want])


def test_tables_of_powers_are_as_long_as_the_texts_need():
    """A worker keeps them: two of 16 MB before, however short the texts."""
    words._POWERS.clear()
    short, long = (words.cut(pa.array([b"one two " * n], pa.binary())).hashes for n in (9, 90_000))
    assert np.array_equal(short[:18], long[:18]) and len(set(long.tolist())) == 2
    words._POWERS.clear()
    words.cut(pa.array([b"one two"], pa.binary()))
    assert sum(t.nbytes for t in words._POWERS.values()) < 2 << 20


def test_edges_of_a_unit_meet_by_number(spark):
    """Units themselves are no keys where their edges are gathered; without a place to put them apart they are whole as well."""
    model = pieces.Model.load(public_tokenizers.path("piece_bpe_32k.model"))
    found = spark.createDataFrame([(i % 3, f"{pieces.MARK}word{i}\u0f3a") for i in range(500)], "part long, unit string").repartition(3, "part")
    made = pieces.unit_ids(found, model)
    keys = re.findall(r"ObjectHashAggregate\(keys=\[(.*?)\]", made._jdf.queryExecution().executedPlan().toString())
    assert keys and all("unit" not in k for k in keys)
    want = {u: pieces._long_unit(model.path, u) for u in (r.unit for r in found.collect())}
    assert {r.unit: r.ids for r in made.collect()} == want == {r.unit: r.ids for r in pieces.unit_ids(found.select("unit"), model).collect()}


def test_blocks_of_a_batch_are_even(monkeypatch):
    """The largest was a whole ``BLOCK`` before, however little was left for the last."""
    monkeypatch.setattr(pieces, "BLOCK", 14_000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array([b"x" * 9 + b" " + b"y" * 990] * 30, pa.binary())], names=["doc_id", "text"])
    run = pieces._sent(public_tokenizers.path("piece_bpe_32k.model"), 3)
    blocks = [[d for d in b.column("doc_ids").to_pylist() if d is not None] for b in run(iter([batch]))]
    assert [len(ids) for b in blocks for ids in b] == [10, 10, 10]
    assert [i for b in blocks for ids in b for i in ids] == list(range(30))
    assert list(run(iter([batch.slice(0, 0)]))) == []
