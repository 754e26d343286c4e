"""Conversation blocks and scores, word statistics, vectors, scenes, recommendations on hand-made rows."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from activity_engine.functions import calendar as cal
from activity_engine.functions import text as tx
from activity_engine.functions import vectors as vf
from activity_engine.operators import album, corpus, density, lookups, profiles, reco, report, select, terms, vectors


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_blocks_of_three_senders(spark):
    rows = [(1, 0, "a", "x"), (1, 1, "a", "y"), (1, 2, "b", "z"), (1, 3, "c", "w"), (1, 4, "a", "v"), (2, 0, "b", "alone")]
    blocks = corpus.turn_blocks(spark.createDataFrame(rows, "conv int, seq int, who string, text string"), "conv", "seq", "who", "text")
    got = sorted((r["conv"], r["block_no"], r["sender"], r["text"], r["n_msgs"]) for r in blocks.collect())
    assert got == [(1, 0, "a", "x\ny", 2), (1, 1, "b", "z", 1), (1, 2, "c", "w", 1), (1, 3, "a", "v", 1), (2, 0, "b", "alone", 1)]


STYLE = corpus.Style(tx.word_pattern(["sig"]), tx.word_pattern(["sl"]), tx.word_pattern(["why"]))


@pytest.mark.parametrize("text, score", [
    ("", 0), ("sig", 3), ("sl", 1), ("sl sl", 3), ("why sig", 5), ("a\nb", 0), ("a\nb\nc", 3), ("\n".join("abcdef"), 7),
    (" ".join(["w"] * 30), 0), (" ".join(["w"] * 31), 2), (" ".join(["w"] * 100), 2), (" ".join(["w"] * 101), 5), ("sigx ésig", 0)])
def test_style_score(spark, text, score):
    assert one(spark, corpus.block_score(F.lit(text), STYLE)) == score


def test_default_style_words(spark):
    assert one(spark, corpus.block_score(F.lit("mouais du coup dcp"), corpus.Style())) == 6


def test_windows_need_enough_history(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "o", "sl"), (1, 1, "me", "sig sig sig"), (1, 2, "o", "why sl"), (1, 3, "me", "sig sig")],
        "conv int, block_no long, sender string, text string")
    expected = {(1, 1): ["sl"], (3, 1): ["why sl"], (3, 2): ["sig sig sig", "why sl"]}
    made = corpus.context_windows(blocks, "conv", "me", (1, 2, 5))
    assert {(r["block_no"], r["size"]): [h["text"] for h in r["history"]] for r in made.collect()} == expected
    scores = corpus.window_scores(blocks, "conv", "me", STYLE, (1, 2, 5))
    assert {(r["block_no"], r["size"]): r["score"] for r in scores.collect()} == {(1, 1): 10.0, (3, 1): 8.0, (3, 2): 7.0}
    again = corpus.with_history(scores, blocks, "conv")
    assert {(r["block_no"], r["size"]): [h["text"] for h in r["history"]] for r in again.collect()} == expected
    best = corpus.messages_of(corpus.with_history(corpus.best_per_person(scores, "conv", 7, 1), blocks, "conv"), "me")
    row = best.select("messages", corpus.example_score(F.col("messages"), STYLE).alias("s"),
                      corpus.corpus_text(F.col("messages"), F.lit(1), "Me", "You").alias("t"), corpus.chat_json(F.col("messages")).alias("j")).first()
    assert [(m["role"], m["content"]) for m in row["messages"]] == [("user", "sl"), ("assistant", "sig sig sig")]
    assert row["s"] == 9.0 and row["t"] == "--- Exemple 1 ---\nYou: sl\nMe: sig sig sig\n"
    assert row["j"] == '{"messages":[{"role":"user","content":"sl"},{"role":"assistant","content":"sig sig sig"}]}'


def test_text_functions(spark):
    damaged = "déjà vu".encode().decode("latin-1")
    assert one(spark, tx.fix_mojibake(F.lit(damaged))) == "déjà vu"
    assert one(spark, tx.fix_mojibake(F.lit("déjà"))) == "déjà" and one(spark, tx.fix_mojibake(F.lit("日本"))) == "日本"
    assert one(spark, tx.word_count(F.lit(""))) == 0 and one(spark, tx.word_count(F.lit("  a  b "))) == 2
    assert one(spark, tx.redact(F.lit("Anna, annabel et ANNA"), ["anna"])) == "[PRÉNOM], annabel et [PRÉNOM]"
    assert one(spark, tx.is_chat_noise(F.lit("Bob a envoyé une pièce jointe."))) and not one(spark, tx.is_chat_noise(F.lit("salut")))
    assert one(spark, tx.is_ad(F.lit("https://x"), F.lit("Publicité"))) and not one(spark, tx.is_ad(F.lit("https://x"), F.lit("add")))
    assert one(spark, tx.is_noise(F.lit("foo foo.com"), [tx.TITLE_NOISE])) and not one(spark, tx.is_noise(F.lit("foo bar.com"), [tx.TITLE_NOISE]))
    assert one(spark, cal.dms_to_decimal(F.lit(48.0), F.lit(30.0), F.lit(36.0), F.lit("S"))) == pytest.approx(-48.51)


@pytest.mark.parametrize("name, day", [
    ("IMG_20240105_101112.jpg", 5), ("a/2024-01-06 x.png", 6), ("WA20240107.jpg", 7), ("x123456789.jpg", None),
    ("IMG_20241305.jpg", None), ("19991231.jpg", None), ("20240101/none.jpg", None)])
def test_filename_date(spark, name, day):
    expected = day and dt.datetime(2024, 1, day, 12)
    assert one(spark, cal.filename_date(F.lit(name))) == expected


@pytest.mark.parametrize("month, number", [("avril", 4), ("octobre", 10), ("nov.", 11), ("décembre", 12), ("juin", 6), ("juil.", 7), ("floréal", None)])
def test_french_months(spark, month, number):
    expected = int(dt.datetime(2024, number, 3, 4, 5, 6, tzinfo=dt.timezone.utc).timestamp() * 1000) if number else 0
    assert one(spark, cal.french_date_millis(F.lit(f"vu le 3 {month} 2024, 04:05:06"))) == expected


def test_title_search_levels(spark):
    titles = spark.createDataFrame([("red ring", 1), ("big red ring", 5), ("small red ring", 9), ("blue rod", 2)], "title string, score int")
    got = {r["wanted"]: (r["title"], r["level"]) for r in lookups.find_titles(titles, "title", "score", ["Red Ring", "red", "bluu rod", "zzz"]).collect()}
    assert got == {"red ring": ("red ring", 1), "red": ("small red ring", 2), "bluu rod": ("blue rod", 3)}


def test_matching_blocks(spark):
    """The measure, its bound, and literals of the search it stands for."""
    from difflib import SequenceMatcher

    assert lookups.matching_ratio("matrix the", "the matrix") == 0.6 and lookups.matching_ratio("", "") == 1.0
    rnd = np.random.default_rng(3)
    pairs = [("".join(rnd.choice(list("abcé "), rnd.integers(0, 14))), "".join(rnd.choice(list("abcé "), rnd.integers(0, 14)))) for _ in range(400)]
    for a, b in pairs:
        assert lookups.matching_ratio(a, b) == pytest.approx(SequenceMatcher(None, a, b, autojunk=False).ratio(), abs=1e-12)
    for a in ("abba", "é", "", "aab c"):
        rows = spark.createDataFrame([(b,) for _, b in pairs[:80]], "b string").select("b", lookups.ratio_bound(a, F.col("b")).alias("bound")).collect()
        assert all(r["bound"] >= lookups.matching_ratio(a, r["b"]) - 1e-12 for r in rows)
    titles = spark.createDataFrame([("The Matrix", 1), ("Matrix Reloaded", 5), ("matrix", None), (None, 9), ("Dark", 3)], "title string, score int")
    got = {r["wanted"]: (r["title"], r["level"]) for r in lookups.find_titles(titles, "title", "score", ["matrix the", "MATRIX ", "reload", "drak", "  ", "zzz"]).collect()}
    assert got == {"matrix the": ("matrix", 3), "matrix": ("matrix", 1), "reload": ("Matrix Reloaded", 2), "drak": ("Dark", 3)}
    assert lookups.find_titles(titles, "title", "score", [" "]).count() == 0


def test_anchors_of_many_lengths(spark):
    rnd = np.random.default_rng(4)
    word = lambda n: "".join(rnd.choice(list("abé "), n))
    titles = [word(rnd.integers(0, 30)) for _ in range(150)] + [None]
    anchors = sorted({word(rnd.integers(1, 25)) for _ in range(80)} | {t[i:i + n] for t in titles[:60] for i, n in ((2, 9), (0, 17), (5, 3)) if t})
    items = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    listed = spark.createDataFrame([(a,) for a in anchors] + [(None,), ("",), (anchors[0],)], "anchor string")
    got = sorted((r["id"], r["anchor"]) for r in lookups.contained_anchors(items, "title", listed, "anchor").collect())
    assert got == sorted((i, a) for i, t in enumerate(titles) for a in anchors if t is not None and a and a in t)
    long = [a for a in anchors if len(a) >= 3]
    met = lookups.anchor_candidates(items, "title", listed.filter("length(anchor) >= 3"), "anchor").count()
    assert met < .25 * len(long) * len(titles)


def test_contained_anchors(spark):
    items = spark.createDataFrame([(1, "the matrix"), (2, "matrix the"), (3, "cat")], "id int, title string")
    anchors = spark.createDataFrame([("matrix",), ("the",), ("",), ("catalogue",)], "anchor string")
    got = sorted((r["id"], r["anchor"]) for r in lookups.contained_anchors(items, "title", anchors, "anchor").collect())
    assert got == [(1, "matrix"), (1, "the"), (2, "matrix"), (2, "the")]


def test_terms(spark):
    texts = spark.createDataFrame([(1, "s", "Big red the dog"), (1, "s", "big red cat 4you"), (1, "s", "mail a@b.c big red")], "c int, s string, text string")
    got = {r["term"]: r["n"] for r in terms.top_terms(terms.unigrams(texts, "text", ["the"]), ["c"], 9).collect()}
    assert got == {"big": 2, "red": 2, "dog": 1, "cat": 1}
    pairs = {r["term"]: r["n"] for r in terms.top_terms(terms.bigrams(texts, "text", ["the"]), ["c"], 9).collect()}
    assert pairs == {"big red": 2, "red dog": 1, "red cat": 1}
    profile = terms.keyword_profiles(texts, "c", "s", "text", ["the"], n_bigrams=1, n_words=2).first()
    assert profile["keywords"] == ["big red", "big", "red"]
    assert "faire" in terms.default_stop_words(spark) and "nous" in terms.default_stop_words(spark)
    claims = {r["s"]: r["category"] for r in terms.first_claims(spark.createDataFrame([("Red dog",), ("DOG",), ("x",)], "s string"), "s", {"colour": ["red"], "animal": ["dog"]}).collect()}
    assert claims == {"red dog": "colour", "dog": "animal"}


def test_counted_tables_give_what_rows_of_words_give(spark, monkeypatch):
    """Terms counted in tables, some texts at a time and part by part, against one row per word; nulls, odd spaces and ties among them."""
    monkeypatch.setattr(terms, "COUNTED_AT_ONCE", 1 << 10)
    rnd = random.Random(3)
    words = ["alpha", "the", "béta", "ÉCLAIR", "x", "", "9lives", "no9", "50%", "(ab)", "gamma", "\u00a0wide", "Straße", "delta", "İx"]
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]), rnd.choice([" ", "\t", " \n "]).join(rnd.choices(words, k=rnd.randint(0, 40)))) for _ in range(300)]
    rows += [("a", 1, t) for t in ("", "   ", None, "@ alpha gamma", "https://alpha gamma", "  lead and trail \n\r\x0b\x0c ", "\x1falpha\x1fgamma x", "alpha%20gamma")]
    texts = spark.createDataFrame(rows, "c string, s int, text string").repartition(3)
    for width, terms_of in ((1, terms.unigrams), (2, terms.bigrams)):
        for groups in (["c"], ["c", "s"]):
            plain = terms_of(texts, "text", ["the", "and"])
            counted = terms.term_counts(texts, groups, "text", ["the", "and"], width)
            every = {tuple(r) for r in plain.groupBy(*groups, "term").count().collect()}
            assert {tuple(r) for r in counted.collect()} == every and counted.count() == len(every)
            for k in (1, 4):
                best = terms.top_counts(terms.term_counts(texts, groups, "text", ["the", "and"], width, k), groups, k)
                assert set(best.collect()) == set(terms.top_terms(plain, groups, k).select(best.columns).collect())
            texts_with = plain.select(*groups, "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
            told = terms.term_counts(texts, groups, "text", ["the", "and"], width, spread="df").select("term", "df").distinct()
            assert sorted(told.collect()) == sorted(texts_with.collect())
    assert terms.term_counts(texts.limit(0), ["c"], "text", ["the"], 2, 5).count() == 0


def test_tfidf_joins_nothing(spark):
    """A text's words and the number of texts with them come from one pass; a repeated id is one text."""
    texts = spark.createDataFrame([(1, "red red dog"), (2, "red cat"), (2, "cat bird"), (3, None), (4, "")], "i int, text string")
    made = terms.tfidf(texts, "i", "text", [], 3)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert {(r.i, r.term): (r.tf, r.df) for r in made.collect()} == {
        (1, "red"): (2, 2), (1, "dog"): (1, 1), (2, "red"): (1, 2), (2, "cat"): (2, 1), (2, "bird"): (1, 1)}


def test_keyword_profiles_read_all_sources(spark):
    texts = spark.createDataFrame([(1, s, f"{w} {w}") for s, w in zip(["e", "b", "d", "a", "c", None], ["echo", "bravo", "delta", "alpha", "charlie", "null"])] + [
        (2, "e", "echo"), (None, "a", "alpha")], "c int, s string, text string")
    found = {r["c"]: r["keywords"] for r in terms.keyword_profiles(texts, "c", "s", "text", [], n_bigrams=0).collect()}
    assert found == {1: ["null", "alpha", "bravo", "charlie", "delta", "echo"], 2: ["echo"]}
    report = {r["c"]: r["keywords"] for r in terms.keyword_profiles(texts.where("s is not null"), "c", "s", "text", [], sources=3, n_bigrams=0).collect()}
    assert report == {1: ["alpha", "bravo", "charlie"], 2: ["echo"]}


@pytest.mark.parametrize("group_bytes", [1 << 20, 200])
def test_best_matches_is_exact_in_groups(spark, group_bytes):
    rng = np.random.default_rng(1)
    points, refs = rng.normal(size=(30, 4)), rng.normal(size=(25, 4))
    left = spark.createDataFrame(pd.DataFrame({"id": range(30), "v": points.tolist()}))
    right = spark.createDataFrame(pd.DataFrame({"ref": range(25), "r": refs.tolist()}))
    got = {r["id"]: [m["ref"] for m in r["matches"]] for r in vectors.best_matches(left, right, "v", "ref", "r", 3, group_bytes=group_bytes).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    expected = np.argsort(-(unit(points) @ unit(refs).T), axis=1, kind="stable")[:, :3]
    assert got == {i: row.tolist() for i, row in enumerate(expected)}


def test_ties_and_unusable_vectors(spark):
    refs = spark.createDataFrame([(7, [1.0, 0.0]), (3, [2.0, 0.0]), (5, [0.0, 1.0]), (9, [])], "ref int, r array<double>")
    points = spark.createDataFrame([(1, [5.0, 0.0]), (2, []), (3, None), (4, [0.6, 0.8])], "id int, v array<double>")
    got = {r["id"]: (r["ref"], r["similarity"]) for r in vectors.nearest_reference(points, refs, "v", "ref", "r", 0.9).collect()}
    assert got[1][0] == 3 and got[2] == got[3] == got[4] == (None, None)
    ranked = vectors.best_matches(points, refs, "v", "ref", "r", 2).filter("id = 1").first()["matches"]
    assert [m["ref"] for m in ranked] == [3, 7]
    nothing = vectors.nearest_reference(points, refs.filter("ref < 0"), "v", "ref", "r")
    assert {r["ref"] for r in nothing.collect()} == {None}


def test_vector_functions(spark):
    zero, v = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vf.norm(v)) == 5.0 and one(spark, vf.cosine(zero, v)) is None
    assert one(spark, vf.distance(zero, v)) == 5.0


def test_density_clusters(spark):
    line = [(i, [0.05 * i, 0.0]) for i in range(40)]            # one long chain
    heap = [(100 + i, [5.0, 5.0]) for i in range(30)]           # copies of one point
    noise = [(200, [9.0, 0.0]), (201, [0.0, 9.0])]
    df = spark.createDataFrame(line + heap + noise, "id int, p array<double>")
    got = {r["id"]: r["cluster"] for r in density.density_clusters(df, "id", "p", 0.1, 2, 5, 2).collect()}
    assert {got[i] for i, _ in line} == {0} and {got[i] for i, _ in heap} == {1} and got[200] == got[201] == -1


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60).select(F.col("id").alias("node"))
    edges = spark.range(59).filter("id <> 30").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r["node"]: r["component"] for r in density.components(edges, nodes).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(60)}


def test_density_clusters_of_labelled_vectors_are_pure(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.05, size=(80, 2)) for c in (0.0, 3.0, 6.0)])
    df = spark.createDataFrame(pd.DataFrame({"id": range(240), "p": points.tolist()}))
    got = density.density_clusters(df, "id", "p", 0.2, 3, 10, 2).toPandas().sort_values("id")["cluster"].to_numpy()
    for start in (0, 80, 160):
        part = got[start:start + 80]
        assert np.bincount(part[part >= 0]).max() / 80 > 0.9
    assert len(set(got[got >= 0])) == 3


def test_scenes(spark):
    def at(minutes):
        return dt.datetime(2024, 1, 5, 8) + dt.timedelta(minutes=minutes)

    photos = spark.createDataFrame([
        ("a", 1, at(0), "x.jpg", [1.0, 0.0]), ("a", 2, at(20), "x.jpg", [1.0, 0.1]), ("a", 3, at(24 * 60), "x.jpg", [0.0, 1.0]),
        ("a", 4, None, "IMG_20240106.jpg", [1.0, 0.0]), ("a", 5, None, "x.jpg", [1.0, 0.05]), ("a", 6, None, "x.jpg", [-1.0, -1.0]),
        ("a", 7, None, "x.jpg", [])], "album string, id int, ts timestamp_ntz, name string, v array<double>")
    got = {r["id"]: (r["scene_id"], r["placed_by"]) for r in album.assign_scenes(photos, "album", "id", "ts", "name", "v", 3600).collect()}
    assert got == {1: (0, "date"), 2: (0, "date"), 3: (1, "date"), 4: (1, "filename"), 5: (0, "vector"), 6: (2, "none"), 7: (2, "none")}


def test_scenes_and_music_of_two_albums_with_equal_ids(spark):
    """A photo's album decides with whom it is compared, wherever photos of another album have its name."""
    def at(minutes):
        return dt.datetime(2024, 1, 5, 8) + dt.timedelta(minutes=minutes)

    photos = spark.createDataFrame([
        ("a", "p", None, "x.jpg", [0.0, 1.0]), ("a", "q", at(0), "x.jpg", [1.0, 0.0]),
        ("b", "p", at(0), "x.jpg", [1.0, 0.0]), ("b", "q", at(900), "x.jpg", [0.0, 1.0]), ("b", "r", None, "x.jpg", [0.1, 1.0]),
        ("c", "p", None, "x.jpg", [0.0, 1.0])], "album string, id string, ts timestamp_ntz, name string, v array<double>")
    got = sorted((r["album"], r["id"], r["scene_id"], r["placed_by"]) for r in album.assign_scenes(photos, "album", "id", "ts", "name", "v", 3600).collect())
    assert got == [("a", "p", 1, "none"), ("a", "q", 0, "date"), ("b", "p", 0, "date"), ("b", "q", 1, "date"), ("b", "r", 1, "vector"), ("c", "p", 0, "none")]

    plays = spark.createDataFrame([("a", at(0), "x"), ("b", at(901), "y"), ("b", at(5000), "z"), ("b", at(5001), "z")], "album string, ts timestamp_ntz, track string")
    none = spark.createDataFrame([], "album string, id string, track string, match_score double")
    pinned = spark.createDataFrame([("a", "p", "m")], "album string, id string, track string")
    matched = album.match_music(photos, plays, pinned, none, none, "album", "id", "ts", "track")
    assert sorted((r["album"], r["id"], r["track"], r["match_type"]) for r in matched.collect()) == [
        ("a", "p", "m", "manual"), ("a", "q", "x", "temporal"), ("b", "p", "z", "fallback"), ("b", "q", "y", "temporal"), ("b", "r", "z", "fallback"), ("c", "p", None, "none")]
    levels = [("fallback", spark.createDataFrame([("c", "w")], "album string, track string"))]
    scenes = album.match_scenes(matched, photos.select("album").unionAll(spark.createDataFrame([("d",)], "album string")), ["album"], levels, "track")
    assert sorted((r["album"], r["track"], r["match_type"], r["votes"]) for r in scenes.collect()) == [
        ("a", "m", "manual", 1), ("b", "y", "temporal", 1), ("c", "w", "fallback", 0), ("d", None, "none", 0)]


def test_interactions_of_two_owners(spark):
    def at(month):
        return dt.datetime(2024, month, 5)

    plays = spark.createDataFrame([("a", "x", at(1)), ("b", "x", at(2)), ("a", "y", at(1)), ("a", "y", at(3))], "who string, item string, ts timestamp_ntz")
    lasting = reco.monthly_interactions(plays, "item", "ts", 2, "who").collect()
    assert sorted((r["who"], r["virtual_user"], r["item"]) for r in lasting) == [("a", 202401, "y"), ("a", 202403, "y")]
    assert reco.monthly_interactions(plays, "item", "ts", 2).count() == 4


def test_profiles(spark):
    assert one(spark, cal.day_slot(F.lit(4), cal.PROFILE_CUTS)) == "night" and one(spark, cal.day_slot(F.lit(5), cal.PROFILE_CUTS)) == "morning"
    assert one(spark, cal.day_slot(F.lit(23), cal.CONTEXT_CUTS)) == "night out party" and one(spark, cal.day_slot(F.lit(0), cal.CONTEXT_CUTS)) == "late night dark quiet"
    weeks = one(spark, cal.month_weeks(F.lit("2024-02-01").cast("date")))
    assert [(w["week_start"].day, w["shown_start"].day, w["shown_end"].day) for w in weeks] == [(29, 1, 4), (5, 5, 11), (12, 12, 18), (19, 19, 25), (26, 26, 29)]


def test_als_beats_popularity(spark):
    """Two groups of users with different tastes: the held-out item of a user's own group is recommended first."""
    rows = [(u, i, 1.0) for u in range(20) for i in range(10 * (u % 2), 10 * (u % 2) + 10) if i != 10 * (u % 2) + u // 2]
    ratings = spark.createDataFrame(rows, "user int, item int, rating float")
    model = reco.fit_als(ratings, "user", "item", "rating", rank=4, iterations=8)
    top = reco.recommend(model, "user", "item", 10)
    own = top.filter(F.floor(F.col("item") / 10) == F.col("user") % 2)
    assert own.count() >= 0.95 * top.count() and top.groupBy("user").count().filter("count <> 10").count() == 0


@pytest.mark.parametrize("dealt", [128, 20])
def test_als_has_as_many_blocks_as_its_ratings_need(spark, monkeypatch, dealt):
    """A task holds one block of ratings: with a fixed number of blocks it outgrows its memory."""
    monkeypatch.setattr(reco, "BLOCK_RATINGS", 60, raising=False)
    monkeypatch.setattr(reco, "DEALT", dealt, raising=False)
    rows = [(u, i, 1.0) for u in range(80) for i in range(20 * (u % 2), 20 * (u % 2) + 20) if i != 20 * (u % 2) + u // 4]
    model = reco.fit_als(spark.createDataFrame(rows, "user int, item int, rating float"), "user", "item", "rating", rank=4, iterations=4)
    assert model.userFactors.rdd.getNumPartitions() == model.itemFactors.rdd.getNumPartitions() == -(-len(rows) // 60)
    top = reco.recommend(model, "user", "item", 20)
    own = top.filter(F.floor(F.col("item") / 20) == F.col("user") % 2)
    assert top.count() == 80 * 20 and own.count() >= 0.95 * top.count()


def test_capped_sources_and_modes(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 100)], "s string, id int")
    for seed in (None, 5):
        kept = select.capped_per_source(df, "s", "id", 3, seed)
        assert {r["s"]: r["count"] for r in kept.groupBy("s").count().collect()} == {"a": 3, "b": 1}
        assert kept.collect() == select.capped_per_source(df, "s", "id", 3, seed).collect()
    tied = spark.createDataFrame([("g", "y"), ("g", "x"), ("g", "y"), ("g", "x")], "g string, v string")
    assert select.mode_per_group(tied, ["g"], "v", "m").collect()[0]["m"] == "x"


def test_report_sections_are_chosen_by_name(spark):
    part = spark.createDataFrame([("s", "m", "", 1.0)], "section string, metric string, key string, value double")
    assert report.build({"a": lambda: part, "b": lambda: part}, ["a", "b"]).count() == 2
    with pytest.raises(ValueError):
        report.build({"a": lambda: part}, ["c"])


def test_silhouette(spark):
    rows = [(i, *((0.9, 0.1, 0.0, 0.0, 0.1) if i % 2 else (0.0, 0.0, 0.2, 0.8, 0.9))) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, morning double, afternoon double, evening double, night double, weekend_pct double")
    assert profiles.silhouette(profiles.behaviour_clusters(df, k=2, iterations=5)) > 0.95
