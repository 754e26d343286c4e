"""Vector codes against a brute-force version in Python's integers."""

import hashlib
import math
import random
from collections import Counter

import pytest

from activity_engine.llm import vector_codes
from activity_engine.llm.hot import attach
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label string, size int, error int, code string, __label string"


def brute(rows):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for size in {len(v) for _, v, _ in kept}:
        mine = [(i, [max(-2 ** 60, min(2 ** 60, math.floor(4096 * x) if abs(4096 * x) < math.inf else int(math.copysign(2 ** 60, x)))) for x in v], lab)
                for i, v, lab in kept if len(v) == size]
        first = sorted(((math.inf if i is None else i, next(v for j, v, _ in kept[n:] if len(v) == size), w)
                        for n, (i, w, _) in enumerate(mine)), key=lambda r: (r[0], r[2]))[:16]
        book = [w for _, _, w in first]
        edge = [p * size // 8 for p in range(9)]

        def assign(w):
            best = []
            for a, e in zip(edge, edge[1:]):
                far = [sum((x - y) ** 2 for x, y in zip(w[a:e], b[a:e])) for b in book]
                best.append((far.index(min(far)), min(far)))
            return best

        for _ in range(6):
            new = [list(b) for b in book]
            named = [assign(w) for _, w, _ in mine]
            for p, (a, e) in enumerate(zip(edge, edge[1:])):
                for k in range(len(book)):
                    members = [w for (_, w, _), n in zip(mine, named) if n[p][0] == k]
                    for d in range(a, e):
                        if members:
                            new[k][d] = sum(w[d] for w in members) // len(members)
            book = new
        told = hashlib.sha256(",".join(str(x) for a, e in zip(edge, edge[1:]) for b in book for x in b[a:e]).encode()).hexdigest()
        for i, w, lab in mine:
            best = assign(w)
            out.append((i, "".join(f"{k:02x}" for k, _ in best), min(sum(f for _, f in best), 2 ** 63 - 1), lab, told))
    total = Counter()
    for row in out:
        total[row[3]] += row[2]
    return sorted(((i, c, e, min(total[lab], 2 ** 63 - 1), t) for i, c, e, lab, t in out), key=str)


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, lab, 1, 1, "x", "y") for i, v, lab in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in vector_codes.digest(vector_codes.compress(df)[0]).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    near = [[rnd.gauss(0, .3) for _ in range(24)] for _ in range(5)]
    rows = [(i * 3 % 401, [x + rnd.gauss(0, .05) for x in rnd.choice(near)], rnd.choice(["a", "b", None])) for i in range(200)]
    rows += [(i, [.5] * 24, "hot") for i in range(500, 620)] + [rows[4]] * 3 + [(None, [.1] * 24, "a"), (None, [0.] * 24, "")]
    return rows + [(700, None, "a"), (701, [math.nan] + [0.] * 23, "a"), (702, [None] + [0.] * 23, "a"), (703, [math.inf] + [0.] * 23, "a")]


def test_against_brute_force(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 24 * 7)
    assert found(spark, rows) == brute(rows)


def test_other_lengths_have_books_of_their_own(spark, rows):
    odd = rows + [(900 + i, [i / 7] * 5, "a") for i in range(20)] + [(990, [], "z"), (991, [], None)]
    assert found(spark, odd) == brute(odd)


def test_huge_components(spark):
    some = [(i, [float(i), 1e9, -1e12, 3e38, -1e308, 0., 1e-300, -1e-9], "a") for i in range(20)]
    some += [(i, [1e11 + i * 1e9, -i * 1e10, 0., 0., 0., 0., 0., 0.], "b") for i in range(20, 60)]
    assert found(spark, some) == brute(some)


def test_few_and_none(spark, rows):
    assert found(spark, rows[:3]) == brute(rows[:3])
    assert found(spark, rows[-4:]) == []


def test_attach_meets_every_row(spark):
    rows = spark.range(3000).selectExpr("id", "case when id < 1000 then 'hot' when id < 1010 then null else cast(id % 400 as string) end as key")
    facts = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    expected = {r.key: (r.n, r["last"]) for r in facts.collect()}
    got = attach(rows, facts, "key", "n", F.xxhash64("id"), partitions=5).collect()
    assert len(got) == 3000 and all((r.n, r["last"]) == expected.get(r.key, (None, None)) for r in got)
