"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows, clashing
column names and no rows at all."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from activity_engine.llm import (
    decontamination, line_dedup, mixing, neighbours, ngram_join, pieces, quality, sharding, substring_dedup, token_files,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, label int, block int"


@pytest.fixture(scope="module")
def rows():
    """Documents with shared passages, copies, near copies, and every odd row."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice(["th", "er", "on", "an", "ré", "ti", "es", "ou"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = text(80)
    texts = [text(rnd.randint(1, 160)) for _ in range(60)]
    texts += [f"{text(30)} {passage} {text(20)}" for _ in range(12)]
    texts += [texts[3]] * 5 + [None, "", " \t\n ", "one", "One. two, THREE four", passage + "\n" + passage, text(6000)]
    base = text(120).split()
    for _ in range(8):
        near = list(base)
        near[rnd.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    out = [(i * 7 % 1009, t, rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", None]), 1, "x", 1, 9) for i, t in enumerate(texts)]
    return out + [(None, texts[0], "en", "a", 1, "x", 1, 9), (None, None, None, None, None, None, None, None), out[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().split()


def test_substring_dedup(docs, rows, nothing):
    order = lambda d: math.inf if d is None else d
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 49):
            key = tuple(w[i: i + 50])
            first[key] = min(first.get(key, math.inf), order(d))
    expected = []
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i: i + 50])] < order(d):
                gone[i: i + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        expected.append((order(d), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    found = [(order(r.doc_id), r.n_words, r.n_removed, r.kept_sha256)
             for r in substring_dedup.digest(substring_dedup.substring_dedup(docs)).collect()]
    assert sorted(found) == sorted(expected) and sum(e[2] for e in expected) > 500
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_sharding_functions():
    rnd = random.Random(2)
    for _ in range(200):
        sizes, shards = [rnd.randint(1, 40) for _ in range(rnd.randint(0, 25))], rnd.randint(1, 6)
        best = sharding.least_capacity(sizes, shards)

        def fits(capacity):
            used, room = 1, capacity
            for s in sizes:
                if s > capacity:
                    return False
                if s > room:
                    used, room = used + 1, capacity
                room -= s
            return used <= shards

        assert fits(best) and (best == 0 or not fits(best - 1))
        cuts = [0, *sharding.balanced_cuts(sizes, shards, best), len(sizes)]
        assert cuts == sorted(cuts) and all(sum(sizes[a:b]) <= best for a, b in zip(cuts, cuts[1:]))


def test_sharding(docs, rows, nothing):
    found = sharding.digest(sharding.shard_by_bytes(docs, 4)).collect()
    text = {d: t or "" for d, t, *_ in rows if d is not None}
    assert len(found) == len(rows)
    for shard in {r.shard for r in found}:
        mine = [r.slot for r in found if r.shard == shard]
        assert sorted(mine) == list(range(len(mine)))
    homes = {}
    for r in found:
        if r.doc_id is not None:
            assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))
            homes.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    totals, largest = Counter(), max(Counter({t: 0 for t in homes}) + Counter(), default=None)
    for r in found:
        totals[r.shard] += r.size
    groups = Counter()
    for d, t, *_ in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    assert largest is None or max(totals.values()) <= sum(totals.values()) / 4 + max(groups.values())
    assert sharding.shard_by_bytes(nothing).count() == 0


def test_ngram_components(docs, rows, nothing):
    held = {}
    for d, t, *_ in rows:
        w = words((t or "").lower())
        if d is not None:
            held[d] = frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    component = {d: d for d in held}
    changed = True
    while changed:
        changed = False
        for a in held:
            for b in held:
                o = len(held[a] & held[b])
                if o and 100 * o >= 80 * len(held[a] | held[b]) and component[a] != component[b]:
                    component[a] = component[b] = min(component[a], component[b])
                    changed = True
    found = ngram_join.ngram_components(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == {d: (len(held[d]), component[d]) for d in held}
    assert len(set(component.values())) < len(component) - 8
    assert ngram_join.ngram_components(nothing).count() == 0


def test_ngram_components_with_a_third_between(spark):
    """Triples c < a < b: a and b just at the limit, c unlike both but with half of what they share. What a and b have in common
    is then met in groups of two kinds, with c and without, and counts as one."""
    held, rows = {}, []
    for triple in range(150):
        base = [f"w{triple}x{i}" for i in range(49)]
        near = [*base[:24], "changed", *base[25:]]
        third = [*base[:13], *[f"o{triple}x{i}" for i in range(16)], *base[29:]]
        for place, w in enumerate((third, base, near)):
            doc = 10 * triple + place
            rows.append((doc, " ".join(w)))
            held[doc] = frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4))
    component = {}
    for triple in range(150):
        c, a, b = (10 * triple + place for place in range(3))
        likely = {(x, y) for x, y in ((c, a), (c, b), (a, b)) if 100 * len(held[x] & held[y]) >= 80 * len(held[x] | held[y])}
        assert likely == {(a, b)}
        component |= {c: c, a: a, b: a}
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == component


def test_prefix_tree():
    rnd = np.random.default_rng(4)
    base = np.unique(rnd.integers(0, 4000, 300, np.uint64))
    held = [np.unique(np.r_[rnd.permutation(base)[: rnd.integers(150, 300)], rnd.integers(0, 4000, rnd.integers(0, 60), np.uint64)]) for _ in range(60)]
    found = ngram_join.PrefixTree(held).similar(base, 80)
    expected = [i for i, h in enumerate(held) if 100 * len(np.intersect1d(h, base)) >= 80 * len(np.union1d(h, base))]
    assert sorted(found) == expected and expected


def test_marks_never_tell_similar_sets_apart():
    """Marks differ in no more places than sets in n-grams, so no similar pair is left out."""
    rnd = np.random.default_rng(9)
    for _ in range(300):
        pool = rnd.integers(0, 1 << 64, rnd.integers(1, 1500), np.uint64, endpoint=False)
        one, two = (np.unique(pool[rnd.random(len(pool)) < share]) for share in rnd.uniform(0.1, 1, 2))
        unlike = sum((int(a) ^ int(b)).bit_count() for a, b in zip(ngram_join.marks(one).view(np.uint64), ngram_join.marks(two).view(np.uint64)))
        assert unlike <= len(np.setxor1d(one, two)) and len(ngram_join.marks(one)) == ngram_join.MARKS


def test_line_dedup(spark, nothing):
    rows = [(i, f"page {i}\nmenu\n\nfoot {i % 9}" if i % 2 else f"page {i}\nmenu", "a") for i in range(40)] + [
        (100, None, "a"), (101, "", "a"), (102, "menu", "b"), (103, "menu\nmenu", None), (104, "menu", "a"), (104, "menu", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total, pages = Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        for line in set((t or "").split("\n")) - {""}:
            pages[s, line] += 1
    gone = {k for k, n in pages.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * total[k[0]]}
    expected = sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in gone)) for i, t, s in rows if t is not None)
    found = line_dedup.line_dedup(docs).collect()
    assert sorted((r.doc_id, r.text) for r in found if r.text is not None) == expected and ("a", "menu") in gone
    assert [r.doc_id for r in found if r.text is None] == [100]
    assert line_dedup.line_dedup(nothing).count() == 0


def test_edit_place():
    rnd = random.Random(3)
    for _ in range(200):
        item, text = ([rnd.randint(0, 3) for _ in range(n)] for n in (rnd.randint(1, 6), rnd.randint(0, 9)))

        def distance(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row = [i, *row[1:]] if False else _next(row, i, x, b)
            return row[-1]

        def _next(row, i, x, b):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            return new

        best = min(distance(item, text[a:e]) for a in range(len(text) + 1) for e in range(a, len(text) + 1))
        found = decontamination.edit_place(np.array(item, np.uint64), np.array(text, np.uint64), 99)
        assert found[0] == best == distance(item, text[found[1]: found[2]])


def test_decontamination(spark, docs, nothing):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rnd.randint(12, 60)))) for i in range(30)]
    exact, edited = [], []
    for i, t in items:
        w = t.split()
        exact.append((1000 + i, " ".join([*(word() for _ in range(rnd.randint(0, 30))), *w, *(word() for _ in range(9))]).upper()))
        for k in rnd.sample(range(len(w)), max(1, len(w) // 20)):
            w[k] = word()
        edited.append((2000 + i, " ".join([*(word() for _ in range(rnd.randint(0, 30))), *w])))
    clean = [(3000 + i, " ".join(word() for _ in range(200))) for i in range(50)]
    texts = spark.createDataFrame([*exact, *edited, *clean, (None, items[0][1]), (9000, None), (9001, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*items, items[0], (None, "a b c"), (77, None), (78, ""), (79, "zz yy")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontamination.find_items(texts, bench).collect()}
    assert all(found.get((1000 + i, i)) == 0 for i, _ in items)
    assert sum((2000 + i, i) in found for i, _ in items) >= 28
    assert not any(d >= 3000 for d, _ in found)
    assert decontamination.find_items(nothing, bench).count() == 0
    assert decontamination.find_items(docs, bench.where("false")).count() == 0


def test_quality(spark, nothing):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice(["th", "er", "on", "an", "ti"]) for _ in range(3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 120))]
        toxic, junk = i % 10 == 0, i % 10 == 1
        if toxic:
            w[5] = w[20] = "vilest,"
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w), "en", f"s{i % 7}"))
        if i < 400:
            labels.append((i, 0 if junk else 1, int(toxic)))
    rows += [(None, "plain words", None, None), (900, None, "en", "s1"), (901, "", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame([*labels, (None, 0, 1), (5, None, None), labels[0]], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judge(docs, known).where("__keep").collect()}
    held_out = range(400, 600)
    assert all((i in kept) == (i % 10 > 1) for i in held_out if i % 10 != 1) and sum(i in kept for i in held_out if i % 10 == 1) <= 1
    assert quality.judge(nothing, known).count() == 0
    assert quality.judge(docs, known.where("false")).where("__keep").count() == len(rows)


def test_lm_scores(docs, rows, nothing):
    train = Counter()
    aside = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*words((t or "").encode().lower().decode()), b""]
    for d, t, *_ in rows:
        if not aside(d):
            train.update(tokens(t))
    total, distinct = sum(train.values()), len(train)
    expected = sorted((d if d is not None else -1, aside(d), len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), total,
                       round(sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in tokens(t)), 6)) for d, t, *_ in rows)
    found = mixing.score_texts(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                  for r in found) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert mixing.score_texts(nothing).count() == 0


def test_lm_beats_the_word_counts_on_held_out_texts(spark):
    scored = mixing.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    total = scored.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert total.score > total.base


def test_lm_counts_every_kind(spark, monkeypatch):
    """Six kinds of text: each has counts of its own, of its own words alone; a text without a kind counts as the commonest."""
    rows = [(10 * k + i, f"word{k}", f"kind{k}") for k in range(6) for i in range(9 - k)] + [(100, "word0", None)]
    seen = {}

    def stop(vocabulary, kinds):
        seen.update({r["word"].decode(): tuple(r)[1:] for r in vocabulary.collect()})
        assert kinds == 6
        raise InterruptedError

    monkeypatch.setattr(mixing, "train", stop)
    with pytest.raises(InterruptedError):
        mixing.score_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    trained = Counter(t for d, t, _ in rows if zlib.crc32(str(d).encode()) % mixing.FOLDS != mixing.HELD_OUT)
    assert {w: n for w, n in seen.items() if w} == {f"word{k}": tuple(trained[f"word{k}"] * (j == k) for j in range(6)) for k in range(6)}


def test_mixer_is_a_distribution():
    """Over words of one byte and all their continuations, probabilities of the first byte add up to one."""
    counts = np.random.default_rng(1).integers(0, 9, (len(mixing.CONTEXTS), 1 << mixing.SLOT_BITS, 2)).astype(np.float32)
    mixer = mixing.Mixer(counts)
    total = np.zeros(256)
    held = mixing.Spelled([bytes([b]) if b else b"" for b in range(256)])
    first = np.flatnonzero(held.place == 0)
    held.data, held.place, held.word = np.arange(256, dtype=np.uint8), held.place[first], np.arange(256)
    held.contexts = {o: np.full(256, c[first[0]]) for o, c in held.contexts.items()}
    for bit, slots in held.nodes(0):
        p = mixer.predict(mixer.common(slots), slots[-1], held.place)[0]
        total += np.log(np.where(bit == 1, p, 1 - p))
    assert abs(np.exp(total).sum() - 1) < 1e-6


def test_nearest(spark):
    rnd = np.random.default_rng(3)
    vectors = rnd.standard_normal((700, 16)).astype(np.float32)
    vectors[300:420] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] + [1.0] * 15), (1150, [None] + [1.0] * 15), (1200, []),
           (None, [1.0] * 16), rows[50]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours.nearest(table).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(found) == [i for i in range(0, 700, 50)]
    exact = vectors.astype(float)
    unit = exact / np.linalg.norm(exact, axis=1, keepdims=True)
    hits = 0
    for q, got in found.items():
        score = unit @ unit[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-round(score[i], 12), i))[:5]
        hits += len(set(best) & {v for v, _ in got.values()})
        assert sorted(got) == [1, 2, 3, 4, 5] and all(abs(score[v] - s) < 1e-9 for v, s in got.values())
    assert hits >= 0.9 * 5 * len(found)
    assert [found[300][k][0] for k in range(1, 6)] == [7, 301, 302, 303, 304]
    assert neighbours.nearest(table.where("vec_id < 3")).count() == 2
    assert neighbours.nearest(table.where("false")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
@pytest.mark.parametrize("most", [10, 300, 70_000, 1 << 30])
def test_packing(n, most):
    ids = (np.random.default_rng(n).pareto(0.6, n) * 3).astype(np.uint64) % most
    ids = ids.astype(np.uint32)
    assert np.array_equal(token_files.unpack(*token_files.pack(ids), n), ids)


def test_token_files(spark, docs, rows, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    token_files.write_tokens(docs, path, f"{tmp_path}/files", chunk=500)
    found = {(r.doc_id, r.ids_crc32): r for r in token_files.token_index(spark, f"{tmp_path}/files").collect()}
    start = 0
    for d, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        row = found[d, zlib.crc32(ids)]
        assert row.n_tokens == len(ids)
    ordered = sorted(token_files.token_index(spark, f"{tmp_path}/files").collect(), key=lambda r: (r.start, r.n_tokens))
    for row in ordered:
        assert row.start == start
        start += row.n_tokens
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and len(ordered) == len(rows)
    assert {r.doc_id for r in token_files.read_tokens(spark, f"{tmp_path}/files").collect()} == {r[0] for r in rows}
    token_files.write_tokens(nothing, path, f"{tmp_path}/none")
    assert token_files.token_index(spark, f"{tmp_path}/none").count() == 0


def test_word_encoder_asks_once_for_each_stem():
    """Ids and counts of any bytes; words of many texts are looked up together, and a word that comes again is not asked for."""
    import pyarrow as pa

    asked = []

    def encode(words):
        asked.extend(words)
        coded = [list(w.encode()) for w in words]
        return np.array([i for c in coded for i in c], np.uint32), np.array([len(c) for c in coded], np.int64)

    encoder = token_files.WordEncoder(encode)
    texts = [b"", b"  One one, ONE.\tone.,\n", b"<|End|> a. , .", b"\xff\xfe A,\x0b7. " + "É.".encode(), b" "]
    for _ in range(2):
        ids, count = encoder(pa.array(texts, pa.binary()))
        flat = [[i for w in t.split() for i in (w if b"<|" in w else w.lower()).decode("utf-8", "replace").encode()] for t in texts]
        assert ids.tolist() == [i for f in flat for i in f]
        assert count.tolist() == [len(f) for f in flat]
    assert sorted(w for w in asked if w in ("one", "a", "one,", "ONE")) == ["a", "one"]
    assert len(asked) == len(set(asked))


def test_words_encoded_together_are_those_of_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    plain = ["It's e\u0301te\u0301, \u0301x 1999... <", "", "<|endoftext x<| |> <|EndOfText|> \u00a0a\u2003b", " ".join(f"w{i}q" for i in range(300))]
    for texts in (plain, [*plain, "a<|endoftext|>b <|startoftext|> <|startoftext|><|endoftext|>."]):
        ids, count = token_files.word_tokenizer(path)(pa.array([t.encode() for t in texts], pa.binary()))
        coded = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for c in coded for i in c] and count.tolist() == [len(c) for c in coded]


def test_sentencepiece(spark, docs, rows, nothing):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = SentencePieceProcessor(model_file=path), pieces.Model.load(path)
    odd = [(1, "  two  spaces \n\n\ttabs   ", None), (2, "emoji 😀 and ‍, 中文字符 ▁ mark", None), (3, "=" * 300 + " x" * 5, None), (4, "a" * 500, None)]
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).repartition(2)
    held = [(r.doc_id, r.text) for r in table.collect()]
    coded = pieces.encode(table, model).cache()
    assert sorted((d is None, d or 0, library.encode(t or "")) for d, t in held) == sorted(
        (r.doc_id is None, r.doc_id or 0, r.ids) for r in coded.collect())
    plain = sorted((d or 0, (t or "")) for d, t in held if d != 2)
    assert sorted((r.doc_id or 0, r.text) for r in pieces.decode(coded, model).where("doc_id is null or doc_id <> 2").collect()) == plain
    assert pieces.encode(nothing, model).count() == 0


def test_viterbi_against_the_library(spark, tmp_path):
    """The same pieces as a unigram model: the best path is what the library finds."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        raw = proto.ModelProto.FromString(file.read())
    raw.trainer_spec.model_type = pieces.UNIGRAM
    rnd = random.Random(1)
    for piece in raw.pieces:
        if piece.type == 1:
            piece.score = -rnd.uniform(4, 14) - 0.1 * len(piece.piece)
    path = tmp_path / "unigram.model"
    path.write_bytes(raw.SerializeToString())
    model, library = pieces.Model.load(str(path)), SentencePieceProcessor(model_file=str(path))
    texts = ["the whole thing", "representation of responsibility", "unbelievable, really!", "x", "internationalisation"]
    found = spark.createDataFrame([(u,) for t in texts for u in pieces.units(t)], "unit string").distinct()
    ids = {r.unit: r.ids for r in pieces.unit_ids(found, model).collect()}
    for text in texts:
        assert [i for u in pieces.units(text) for i in ids[u]] == library.encode(text)


def test_other_columns_are_kept(docs):
    kept = line_dedup.line_dedup(docs)
    assert kept.columns == [*docs.columns, "__dropped"]
    judged = quality.judge(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    assert judged.columns[: len(docs.columns)] == docs.columns and judged.count() == docs.count()
