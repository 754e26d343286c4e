"""Word, bigram and whole-text frequencies; keyword profiles; category and marker counts; TF-IDF."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from activity_engine.functions import text as tx
from activity_engine.functions.nested import ordered_union
from activity_engine.operators.select import top_per_group
from activity_engine.session import durable, small

# Stop words added to the English and French default lists.
EXTRA_STOP_WORDS = (
    "les", "des", "une", "sur", "avec", "dans", "qui", "que", "par", "plus",
    "tout", "bien", "comme", "mais", "mon", "ton", "son", "nos", "mes",
    "faire", "comment", "aussi", "encore", "très",
    "the", "and", "for", "with", "you", "your", "this", "that", "from",
    "are", "was", "not", "its", "but", "all", "new", "best", "how",
    "https", "http", "www", "com", "org", "net", "html", "utm", "amp",
    "watch", "video", "clip", "official", "officiel", "youtube", "shorts",
    "16x9", "inh", "vid", "1920x1080", "15s", "officiel)", "(clip",
    "(official", "video)", "(ft", "music", "choisissez", "chrome",
    "google", "gmail", "recherche", "online", "redirect", "editor",
    "lil", "trio", "los", "del", "les", "von",
)

#: Digests of each group whose texts are tried first.
LISTED = 64
#: Texts of about so many bytes are counted together before their terms become rows.
COUNTED_AT_ONCE = 16 << 20
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[9:14] = 32


def default_stop_words(spark: SparkSession) -> list[str]:
    """Spark's English and French lists with the extra words."""
    from pyspark.ml.feature import StopWordsRemover

    loaded = [w for lang in ("english", "french") for w in StopWordsRemover.loadDefaultStopWords(lang)]
    return sorted({*loaded, *EXTRA_STOP_WORDS})


def countable(df: DataFrame, text: str) -> DataFrame:
    """Texts that take part in word counts: longer than two characters, no address, url or percent escape."""
    return df.filter((F.length(text) > 2) & ~F.col(text).rlike(tx.UNCOUNTED_TEXT))


def kept_tokens(text: Column, stop_words: Sequence[str]) -> Column:
    return F.filter(tx.tokens(text), lambda w: ~w.isin(*stop_words))


def unigrams(df: DataFrame, text: str, stop_words: Sequence[str]) -> DataFrame:
    """One row per counted word, as column ``term``."""
    return _words(countable(df, text), tx.tokens(F.col(text)), text, stop_words)


def _words(df: DataFrame, pieces: Column, text: str, stop_words: Sequence[str]) -> DataFrame:
    words = df.withColumn("term", F.explode(pieces)).drop(text)
    good = (F.length("term") > 2) & ~F.col("term").rlike(r"^\d|[@%#\(\)]")
    return words.filter(good & ~F.col("term").isin(*stop_words))


def bigrams(df: DataFrame, text: str, stop_words: Sequence[str]) -> DataFrame:
    """One row per pair of words that are neighbours once stop words are gone, as column ``term``."""
    kept = countable(df, text).withColumn("_kept", kept_tokens(F.col(text), stop_words)).drop(text)
    tail = F.slice("_kept", 2, F.greatest(F.size("_kept") - 1, F.lit(0)))
    head = F.slice("_kept", 1, F.greatest(F.size("_kept") - 1, F.lit(0)))
    pairs = F.zip_with(head, tail, lambda a, b: F.concat_ws(" ", a, b))
    found = kept.withColumn("term", F.explode(pairs)).drop("_kept")
    return found.filter((F.length("term") > 5) & ~F.col("term").rlike(r"[@%#\(\)\d]"))


def top_terms(terms: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
    """The ``k`` most frequent terms of each group, of one row per term."""
    return top_counts(terms.groupBy(*groups, "term").agg(F.count("*").alias("n")), groups, k)


def _counted(groups: Sequence[str], stop_words: Sequence[str], width: int, parts: int):
    """Words (``width`` 1) or pairs of neighbours (2) of lower-cased texts, counted by group for some megabytes of texts at a time.
    One row for each of ``parts``, which a term's hash names: (part, table of groups, term and n)."""
    stops = pa.array(stop_words, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * COUNTED_AT_ONCE // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, step):
                rows = batch.slice(start, step)
                texts = rows.column("text")
                held = pa.table(rows.select(groups)) if groups else None
                first, group = _numbered(rows, groups)
                pieces = pc.split_pattern(_single_spaces(texts), " ")
                size = pc.list_value_length(pieces).to_numpy().astype(np.int64)
                coded = pieces.flatten().dictionary_encode()
                known, code = coded.dictionary, coded.indices.to_numpy()
                stop = pc.is_in(known, value_set=stops).to_numpy(zero_copy_only=False)
                if width == 1:
                    good = ~stop & ~pc.match_substring_regex(known, r"^[0-9]|[@%#()]").to_numpy(zero_copy_only=False)
                    at = np.flatnonzero(good[code])
                    terms = [code[at]]
                else:
                    good = ~pc.match_substring_regex(known, r"[@%#()0-9]").to_numpy(zero_copy_only=False)
                    kept = np.flatnonzero(~stop[code])
                    row = np.repeat(np.arange(len(size)), size)[kept]
                    word = code[kept]
                    pair = np.flatnonzero((row[1:] == row[:-1]) & good[word[1:]] & good[word[:-1]])
                    at, terms = kept[pair], [word[pair], word[pair + 1]]
                distinct = np.array([len(first), *[len(known)] * width], np.int64)
                if float(np.prod(distinct.astype(float))) >= 2.0**63:  # texts of some megabytes are far from it
                    raise OverflowError("too many groups and words to number in one slice of texts")
                key = np.repeat(group, size)[at]
                for part in terms:
                    key = key * len(known) + part
                key, n = np.unique(key, return_counts=True)
                words = []
                for _ in terms:
                    key, part = np.divmod(key, max(1, len(known)))
                    words.insert(0, part)
                text = known.take(pa.array(words[0]))
                if width == 2:
                    text = pc.binary_join_element_wise(text, known.take(pa.array(words[1])), " ")
                hashes = np.fromiter(map(zlib.crc32, known.view(pa.binary()).to_pylist()), np.uint64, len(known))
                mixed = np.zeros(len(n), np.uint64)
                for word in words:
                    mixed = (mixed ^ hashes[word]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(32)
                part = np.where(pc.utf8_length(text).to_numpy() > (2 if width == 1 else 5), (mixed % np.uint64(parts)).astype(np.int64), parts)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))  # shorter terms come last and stay here
                found = held.take(pa.array(first[key])) if held else pa.table({})
                found = found.append_column("term", text).append_column("n", pa.array(n, pa.int64())).take(pa.array(order)).combine_chunks()
                filled = np.flatnonzero(np.diff(edges)).tolist()
                tables = [_as_bytes(found.slice(edges[i], edges[i + 1] - edges[i])) for i in filled]
                yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(tables, pa.binary())], names=["part", "counted"])

    return run


def _numbered(rows: pa.RecordBatch | pa.Table, groups: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of each group, and each row's group as a number. Nulls are equal."""
    number = np.zeros(rows.num_rows, np.int64)
    for g in groups:
        column = rows.column(g)
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        code = column.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        number = np.unique(number * (int(code.max()) + 1) + code, return_inverse=True)[1]
    return np.unique(number, return_index=True)[1], number


def _single_spaces(texts: pa.Array) -> pa.Array:
    """Texts with a space for every white-space character, and none at the end."""
    held = pa.concat_arrays([texts])
    _, offsets, data = held.buffers()
    spaced = _SPACES[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    return pc.utf8_rtrim(pa.Array.from_buffers(pa.string(), len(held), [None, offsets, pa.py_buffer(spaced)], offset=held.offset), " ")


def _as_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _summed(groups: Sequence[str], k: int | None, spread: str | None):
    """The terms of one part with all they were counted; with ``k`` only the first of each group, by count and then term; with
    ``spread`` a column of that name that says how many groups have the term."""
    def run(table: pa.Table) -> pa.Table:
        found = pa.concat_tables([pa.ipc.open_stream(t.as_buffer()).read_all() for t in table.column("counted")])
        found = found.group_by([*groups, "term"]).aggregate([("n", "sum")]).select([*groups, "term", "n_sum"]).rename_columns([*groups, "term", "n"])
        if spread:
            code = _numbered(found, ["term"])[1]
            found = found.append_column(spread, pa.array(np.bincount(code)[code], pa.int64()))
        if k is None or not found.num_rows:
            return found
        group = _numbered(found, groups)[1]
        keys = pa.table({"group": group, "n": found.column("n"), "term": found.column("term")})
        n, order = keys.column("n").to_numpy(), np.lexsort((-keys.column("n").to_numpy(), group))
        begin = np.searchsorted(group[order], np.arange(int(group.max()) + 1))
        last = np.minimum(begin + k, np.r_[begin[1:], len(order)]) - 1
        near = np.flatnonzero(n >= n[order[last]][group])  # the k-th count of each group and what is equal to it
        keys = keys.take(pa.array(near))
        sorted_ = near[pc.sort_indices(keys, [("group", "ascending"), ("n", "descending"), ("term", "ascending")]).to_numpy()]
        held = group[sorted_]
        place = np.arange(len(held)) - np.searchsorted(held, held)
        return found.take(pa.array(sorted_[place < k]))

    return run


def term_counts(
    df: DataFrame, groups: Sequence[str], text: str, stop_words: Sequence[str], width: int, k: int | None = None, spread: str | None = None,
) -> DataFrame:
    """(groups, ``term``, ``n``): how often each group has each counted word (``width`` 1, as ``unigrams``) or pair (2, as ``bigrams``).

    Tasks count some megabytes of texts at a time as numbers of words, and only tables of what differs travel, to the part that a
    term's hash names; a part holds terms of all groups. With ``k``, a part gives the ``k`` first terms of each group and no more.
    As all of a term is in one part, the part also knows the number of its groups, a last column if ``spread`` names one.
    """
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lowered = countable(df, text).select(*groups, F.lower(text).alias("text"))
    kinds = "".join(f"`{g}` {df.schema[g].dataType.simpleString()}, " for g in groups)
    found = lowered.mapInArrow(_counted(list(groups), list(stop_words), width, parts), "part int, counted binary")
    return found.groupBy("part").applyInArrow(_summed(list(groups), k, spread), f"{kinds}term string, n long" + (f", `{spread}` long" if spread else ""))


def top_counts(counted: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
    return top_per_group(counted, groups, [F.desc("n"), F.col("term")], k)


def top_texts(df: DataFrame, groups: Sequence[str], text: str, k: int) -> DataFrame:
    """Most frequent whole texts per group that are not noise.

    Counted by digest, so texts are not shuffled. Equal texts are noise or not alike, so the patterns are tried on the first
    ``LISTED`` digests of each group only, and on sixteen times as many for as long as a group lacks some of its ``k``.
    """
    texts = df.select(*groups, text).withColumn("digest", F.sha2(text, 256))
    counted = durable(texts.filter(F.length(text) > 1).groupBy(*groups, "digest").agg(F.count("*").alias("n")))
    noisy = tx.is_noise(F.col(text), [tx.TITLE_NOISE]) | F.col(text).rlike(r"^\s*[A-Z0-9_]{5,}\s")
    listed = max(LISTED, k)
    while True:
        first = small(top_per_group(counted, groups, [F.desc("n"), F.col("digest")], listed, "_place"), 100_000)
        alike = F.lit(True)
        for g in (*groups, "digest"):
            alike &= F.col(f"t.{g}").eqNullSafe(F.col(f"f.{g}"))
        found = texts.alias("t").join(first.alias("f"), alike).groupBy(*[f"f.{g}" for g in groups], "f.digest", "n", "_place").agg(F.any_value(f"t.{text}").alias(text))
        found = durable(found)
        clean = found.filter(~F.col(text).rlike(tx.UNCOUNTED_TEXT) & ~noisy)
        best = durable(top_per_group(clean, groups, [F.desc("n"), F.col("digest")], k))
        # a group is done with k texts, or once all of its digests were tried
        tried = found.groupBy(*groups).agg(F.count("*").alias("_tried")).filter(F.col("_tried") >= listed)
        full = best.groupBy(*groups).agg(F.count("*").alias("_have")).filter(F.col("_have") >= k)
        same = [tried[g].eqNullSafe(full[g]) for g in groups]
        if not tried.join(full, reduce(lambda a, b: a & b, same, F.lit(True)), "left_anti").limit(1).count():
            return best.select(*groups, "digest", "n", "rank", text)
        listed *= 16


def keyword_profiles(
    texts: DataFrame, cluster: str, source: str, text: str, stop_words: Sequence[str],
    sources: int | None = None, n_bigrams: int = 4, n_words: int = 12,
) -> DataFrame:
    """Keywords per cluster: of each of its sources, top bigrams then top words, merged in the order of the sources.

    All clusters in one plan. Texts of all sources are counted, those without a source as one more; a report that shows
    fewer names a number of ``sources``, the first of each cluster, and only their texts are cut into words. Per cluster
    at most its sources x (n_bigrams + n_words) terms are gathered.
    """
    mine = texts.filter(F.col(cluster).isNotNull()).select(cluster, source, text)
    if sources is not None:
        known = mine.groupBy(cluster, source).agg(F.count("*").alias("_n"))
        used = top_per_group(known, [cluster], [F.col(source)], sources, "_source_no").select(cluster, source)
        mine = mine.join(small(used, 100_000), [cluster, source], "left_semi")
    groups = [cluster, source]
    pairs = top_counts(term_counts(mine, groups, text, stop_words, 2, n_bigrams), groups, n_bigrams).withColumn("_kind", F.lit(0))
    words = top_counts(term_counts(mine, groups, text, stop_words, 1, n_words), groups, n_words).withColumn("_kind", F.lit(1))
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct(source, "_kind", "rank", "term"))), lambda x: x["term"]
    )
    return pairs.unionByName(words).groupBy(cluster).agg(ordered_union(ordered).alias("keywords"))


def category_scores(df: DataFrame, text: str, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Texts per category that hold one of its keywords as a word. One pass, one pattern per category."""
    hits = [
        F.count_if(F.lower(F.col(text)).rlike(tx.any_word(words))).alias(name) for name, words in categories.items()
    ]
    return _long(df.agg(*hits), list(categories), "category", "score")


def category_mentions(df: DataFrame, text: str, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Texts per category that hold one of its keywords anywhere, with the share of all texts."""
    hits = [
        F.count_if(tx.contains_any(F.lower(F.col(text)), words)).alias(name) for name, words in categories.items()
    ]
    counted = df.agg(F.count("*").alias("_all"), *hits)
    long = _long(counted, list(categories), "category", "n", keep=["_all"]).filter(F.col("n") > 0)
    return long.select("category", "n", F.round(F.try_divide(100.0 * F.col("n"), F.col("_all")), 6).alias("pct"))


def marker_counts(df: DataFrame, text: str, markers: Sequence[str], k: int) -> DataFrame:
    """Occurrences of each marker as a whole word, the ``k`` most frequent."""
    counts = [F.sum(F.regexp_count(F.col(text), F.lit(tx.word_pattern([m])))).alias(m) for m in markers]
    long = _long(df.agg(*counts), list(markers), "marker", "n").filter(F.col("n") > 0)
    return long.orderBy(F.desc("n"), "marker").limit(k)


def first_claims(topics: DataFrame, topic: str, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each distinct topic with the first category, in the order given, that claims it."""
    lowered = F.lower(F.col(topic))
    claim = F.lit(None).cast("string")
    for name, words in reversed(list(categories.items())):
        claim = F.when(lowered.rlike(tx.any_word(words)), F.lit(name)).otherwise(claim)
    return topics.select(lowered.alias(topic), claim.alias("category")).distinct().filter("category is not null")


def _long(row: DataFrame, names: Sequence[str], key: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """A one-row frame of named counts as (key, value) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias(key), F.col(f"`{n}`").cast("long").alias(value)) for n in names])
    return row.select(*keep, F.explode(pairs).alias("_p")).select(*keep, f"_p.{key}", f"_p.{value}")


def tfidf(df: DataFrame, doc: str, text: str, stop_words: Sequence[str], k: int) -> DataFrame:
    """The ``k`` highest weighted words of each text; weight = count x ln((N + 1) / (texts with the word + 1)).

    Texts are cut into words once, and the number of texts per word is counted where all of a word meets, so nothing is joined.
    """
    counts = term_counts(df, [doc], text, stop_words, 1, spread="df").select("term", doc, F.col("n").alias("tf"), "df")
    total = df.agg(F.count("*")).scalar()
    weighted = counts.withColumn("weight", F.round(F.col("tf") * F.log((total + 1) / (F.col("df") + 1)), 6))
    return top_per_group(weighted, [doc], [F.desc("weight"), F.col("term")], k)


def content_clusters(
    df: DataFrame, doc: str, text: str, stop_words: Sequence[str], k: int, seed: int = 42, slots: int = 1 << 18, iterations: int = 20,
) -> DataFrame:
    """Texts grouped by k-means on normalised TF-IDF vectors. Texts are cut into words once; fit and result read their counts."""
    words = df.select(doc, text).select(doc, kept_tokens(F.col(text), stop_words).alias("_words"))
    counted = durable(HashingTF(inputCol="_words", outputCol="_tf", numFeatures=slots).transform(words).select(doc, "_tf"))
    weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted).transform(counted)
    scaled = Normalizer(inputCol="_tfidf", outputCol="features").transform(weighted)
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(scaled)
    return model.transform(scaled).select(doc, F.col("prediction").alias("cluster"))
