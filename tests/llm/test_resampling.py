"""Importance resampling against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from activity_engine.llm import resampling

DOCS = "doc_id long, text string, n_words string, score int, rank int, weight int, __row int, __a int"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    found = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return found, [zlib.crc32(x) % 10000 for x in [*found, *(a + b" " + b for a, b in zip(found, found[1:]))]]


def brute(rows, target):
    every = [features(t) for _, t in rows]
    s, t = Counter(x for _, f in every for x in f), Counter(x for text in target for x in features(text)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in range(10000)]
    out = []
    for (doc, _), (found, f) in zip(rows, every):
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), None, len(found)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    for i, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def found(df):
    return sorted((tuple(r) for r in resampling.digest(df).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    vocabulary = ["Straße", "the", "of", "naïve", "x" * 90, "y" * 48, "z" * 49, "日本語", "a1", "Q", "under_score", "semi;colon", "42"]
    vocabulary += ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(200)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    copies = rows[7][1] + " " + rows[8][1]
    rows += [(1000 + i, copies) for i in range(150)] + [(5, rows[5][1])] * 40 + [(None, rows[9][1]), (None, None), (400, ""), (401, " ;; \n")]
    return rows + [(402, "one"), (403, "long " * 3000), (404, "w" * 5000), (None, rows[9][1]), (5, copies)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1, 1, 1) for r in rows], DOCS)


@pytest.mark.parametrize("few", [4096, 5])
def test_against_brute_force(spark, rows, monkeypatch, few):
    monkeypatch.setattr(resampling, "FEW", few)
    target = [rows[3][1], None, "", rows[11][1] + " naïve Straße"]
    drawn = resampling.resample(frame(spark, rows).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert found(drawn) == brute(rows, target)


def test_long_texts_in_pieces(rows, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 37)
    for _, text in rows:
        parts = list(resampling._long((text or "").encode()))
        expected = features(text)
        assert sum(len(w) for w, _ in parts) == len(expected[0])
        assert sorted(int(x) for part in parts for some in part for x in some) == sorted(expected[1])


def test_long_texts_through_spark(spark):
    text = "alpha beta " * (resampling.PIECE // 11 + 50_000)
    some = [(1, text), (2, "beta alpha " * 30)]
    drawn = resampling.resample(frame(spark, some), spark.createDataFrame([("alpha",)], "text string"))
    assert found(drawn) == brute(some, ["alpha"])


def test_cutoff_is_exact_at_every_rank(spark, monkeypatch):
    monkeypatch.setattr(resampling, "FEW", 2)
    rnd = random.Random(1)
    keys = [(rnd.randint(-3, 3), rnd.randint(0, 9), 0, i) for i in range(120)]
    blocks = spark.createDataFrame(keys, resampling._KEY).repartition(4).mapInArrow(resampling._blocks, "n long, keys binary").cache()
    for k in (1, 2, 59, 60, 119, 120):
        assert resampling.cutoff(blocks, k) == sorted(keys)[k - 1]


def test_an_offer_leaves_an_eighth_on_either_side():
    rnd = random.Random(9)
    for _ in range(50):
        blocks = [sorted((rnd.random(),) for _ in range(rnd.randint(1, 200))) for _ in range(rnd.randint(1, 12))]
        tasks = [blocks[i::3] for i in range(3) if blocks[i::3]]
        offers = [(resampling._weighted_median([(b[(len(b) - 1) // 2], len(b)) for b in t]), sum(map(len, t))) for t in tasks]
        pivot, total = resampling._weighted_median(offers), sum(map(len, blocks))
        at_most = sum(x <= pivot for b in blocks for x in b)
        assert at_most >= total / 8 and total - at_most + 1 >= total / 8 - len(blocks)


def test_empty_tables(spark, rows):
    nothing, texts = frame(spark, []), spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(nothing, texts).count() == 0
    some = rows[:50]
    assert found(resampling.resample(frame(spark, some), texts.where("false"))) == brute(some, [])
    assert resampling.draw(resampling.scores(frame(spark, [(1, "too short")]), np.zeros(10000, np.int64))).where(F.col("rank").isNotNull()).count() == 0
