"""The mixer's weights come from every training word."""

import time

import numpy as np
import pyarrow as pa
import pytest

from activity_engine.llm import mixing


@pytest.fixture
def vocabulary(spark):
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.integers(97, 105, rng.integers(1, 9)).tolist()) for _ in range(900)})
    rows = [(bytearray(w), i % 3, 70 * (i % 5)) for i, w in enumerate(words)]
    return rows, spark.createDataFrame(rows, "word binary, n_0 long, n_1 long").repartition(5)


def test_every_training_word_is_stepped_on_whatever_the_number_of_tasks(vocabulary, monkeypatch):
    rows, table = vocabulary
    want = sum(n * 8 * (len(w) + 1) for w, *counts in rows for n in counts)
    whole, real = [], mixing._averaged

    def averaged(parts, sights, before):
        whole.append((len(parts), sights.sum()))
        return real(parts, sights, before)

    monkeypatch.setattr(mixing, "_averaged", averaged)
    one = mixing.train(table, 2)
    monkeypatch.setattr(mixing, "FIT_WORDS", 100)
    many = mixing.train(table, 2)
    assert [n for n, _ in whole] == [1] * 4 + [-(-len(rows) // 100)] * 4
    assert all(seen == want for _, seen in whole)
    assert np.abs(many.weights - one.weights).max() < 0.5 and np.isfinite(many.refined).all()
    assert not np.array_equal(many.weights, mixing.Mixer(one.counts).weights)


def test_averages_count_by_what_was_seen():
    got = mixing._averaged(np.array([[1.0, 5, 7], [4.0, 6, 8]]), np.array([[2.0, 0, 0], [1.0, 3, 0]]), np.array([9.0, 9, 9]))
    assert got.tolist() == [2.0, 6.0, 9.0]


def test_a_mixer_travels_compressed():
    """The counters of few words are a few bytes on disk and in a broadcast, and come back as they were."""
    import pickle

    counts = np.zeros((3, 1 << 16, 2), np.float32)
    counts[1, 77] = 3, 5
    mixer = mixing.Mixer(counts)
    sent = pickle.dumps(mixer)
    back = pickle.loads(sent)
    assert len(sent) < counts.nbytes / 20
    assert np.array_equal(back.counts, counts) and np.array_equal(back.weights, mixer.weights) and back.counts.dtype == counts.dtype


def test_a_held_out_text_costs_its_own_words_however_many_words_its_block_has():
    aside = [i for i in range(20_000) if mixing.is_held_out(pa.array([i]))[0]][:2_000]
    learnt = next(i for i in range(9) if not mixing.is_held_out(pa.array([i]))[0])
    texts = [b" ".join(b"w%d" % i for i in range(50_000)), *[b"w1 v%d" % i for i in aside]]
    table = pa.table([pa.array([learnt, *aside], pa.int64()), pa.array(texts, pa.binary()), pa.array([3] * len(texts), pa.int32())],
                     names=["doc_id", "text", "block"])
    began = time.process_time()
    got = {r["word"]: r["n"] for r in mixing._block_words(table).to_pylist()}
    assert time.process_time() - began < 1
    assert got == {b"w%d" % i: 1 for i in range(50_000)} | {b"v%d" % i: 0 for i in aside} | {mixing.END: 1}


def test_what_words_begin_with_alike_is_judged_once(monkeypatch):
    """Steps and scores go through the bytes by which sorted words differ, not all; scores are those of single words."""
    rng = np.random.default_rng(8)
    words = sorted({b"common" + bytes(rng.integers(97, 101, rng.integers(0, 6)).tolist()) for _ in range(400)} | {mixing.END, b"com", b"\xff"})
    bytes_ = sum(len(w) + 1 if w else 1 for w in words)
    mixer = mixing.Mixer(rng.integers(0, 50, (len(mixing.CONTEXTS), 1 << mixing.SLOT_BITS, 2)).astype(np.float32))
    judged, real = [], mixing.Mixer.common
    monkeypatch.setattr(mixing.Mixer, "common", lambda self, slots, known=None: judged.append(len(slots[0])) or real(self, slots, known))
    got = mixer.log10(words, 2)
    assert sum(judged) < 8 * bytes_ / 2
    assert np.allclose(got, np.concatenate([mixer.log10([w], 2) for w in words]), rtol=1e-12)
    mixed = [words[i] for i in rng.permutation(len(words))]
    assert np.allclose(mixer.log10(mixed, 2), got[[words.index(w) for w in mixed]], rtol=1e-12)
    judged.clear()
    counts = rng.integers(1, 9, len(mixed)).astype(float)
    kinds = np.arange(len(mixed)) % 2
    mixer.learn(mixed, kinds, counts, 0.02)
    assert sum(judged) < 8 * bytes_ / 2
    assert mixer.sights.sum() == 8 * sum((len(w) + 1 if w else 1) * n for w, n in zip(mixed, counts))


def test_tables_count_every_decision_of_every_word():
    words, n = [b"ab", b"b", b"abc", b"ab\xff", b""], [[3, 0, 1, 2, 5], [0, 4, 1, 0, 0]]
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *[pa.array(c, pa.int64()) for c in n]], names=["word", "n_0", "n_1"])
    rows = next(mixing._table_parts(2)(iter([batch])))
    got = np.concatenate([np.frombuffer(s, "<f4") for s in rows.column("sums").to_pylist()]).reshape(len(mixing.CONTEXTS), -1)
    want = np.zeros_like(got)
    for kind, counts in enumerate(n):
        for word, times in zip(words, counts):
            for bit, slots in mixing.Spelled([word]).nodes(kind):
                for context, slot in enumerate(slots):
                    np.add.at(want[context], 2 * slot + bit, times)
    assert np.array_equal(got, want)
