"""Counts, patterns, urls, titles, nested values, word statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.functions import nested, titles, urls
from activity_engine.functions import text as tx
from activity_engine.operators import terms
from activity_engine.operators.merge import surviving_versions
from activity_engine.plans.params import CATEGORIES, JUNK_RULES, MARKERS, PRODUCT_RULES, REDACTED, STOP_WORDS
from activity_engine.plans.registry import Tables, query, sql_list
from activity_engine.sources import activity_html, manifest


def hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def word_hits(text: str, words) -> str:
    """Occurrences of whole words. Accented letters are folded to x first, as \\b knows ASCII letters only there."""
    folded = rf"regexp_replace({text}, '[^\x00-\x7F\P{{L}}]', 'x', 'g')"
    return rf"len(regexp_extract_all({folded}, '(?i)\b({'|'.join(words)})\b'))"


# ---- counts and rules

@query(f"""select doc_id, length(text)::int as chars, {hits('text', chr(92) + 'S+')}::int as words,
 len(list_filter(string_split(regexp_replace(text, '[\\w\\s.,!?;:''"\\-()]', ' ', 'g'), ' '), lambda x: x <> ''))::int as nonascii_tokens,
 {hits('text', chr(92) + 'p{So}')}::int as emojis from documents""")
def text_counts(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.texts.select(
        "doc_id", tx.char_count(text).alias("chars"), tx.word_count(text).alias("words"),
        tx.nonascii_token_count(text).alias("nonascii_tokens"), tx.emoji_count(text).alias("emojis"),
    )


@query(f"""select lang, count(*) as n, round(avg(length(text)), 4) as avg_chars, round(avg({hits('text', chr(92) + 'S+')}), 4) as avg_words
 from documents group by lang""")
def text_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("avg_chars"),
        F.round(F.avg(tx.word_count(F.col("text"))), 4).alias("avg_words"),
    )


_RULE_CASE = "case " + " ".join(f"when regexp_matches(text, '{p}') then '{n}'" for n, p in JUNK_RULES.items()) + " end"


@query(f"select doc_id, lang from documents where {_RULE_CASE} is null")
def noise_filter(t: Tables) -> DataFrame:
    return t.texts.filter(tx.matched_rule(F.col("text"), JUNK_RULES).isNull()).select("doc_id", "lang")


@query(f"select coalesce({_RULE_CASE}, 'clean') as noise_rule, count(*) as n from documents group by noise_rule")
def noise_rule_counts(t: Tables) -> DataFrame:
    rule = F.coalesce(tx.matched_rule(F.col("text"), JUNK_RULES), F.lit("clean")).alias("noise_rule")
    return t.texts.groupBy(rule).agg(F.count("*").alias("n"))


_CHAT = (*tx.CHAT_NOISE, "que la", "nicht ")


@query(f"select conv_id, turn, text = '' or regexp_matches(text, '(?i){'|'.join(_CHAT)}') as is_noise from conversations")
def chat_noise(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", tx.is_chat_noise(F.col("text"), _CHAT).alias("is_noise"))


@query("""select conv_id, turn, case when role = 'system' then 'unsent' when contains(text, '```') then 'code'
 when contains(text, '?') then 'share' when text <> '' then 'text' else 'other' end as msg_type from conversations""")
def msg_type(t: Tables) -> DataFrame:
    flags = {"unsent": F.col("role") == "system", "code": F.col("text").contains("```"), "share": F.col("text").contains("?")}
    return t.conversations.select("conv_id", "turn", tx.message_type(flags, F.col("text")).alias("msg_type"))


@query("""select c_custkey, substr(sha256('salt' || c_name), 1, 10) as pseudonym from customer""")
def pseudonymise(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", tx.pseudonym(F.col("c_name"), "salt").alias("pseudonym"))


@query("select doc_id, text from documents")
def fix_mojibake(t: Tables) -> DataFrame:
    """Texts read in the wrong encoding, repaired; texts that were never damaged must stay."""
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    text = F.when(F.col("lang").isin("en", "es"), F.col("text")).otherwise(damaged)
    return t.documents.select("doc_id", tx.fix_mojibake(text).alias("text"))


_SEPARATOR = r"[^\p{L}\p{N}_]"


@query(rf"""select doc_id, replace(regexp_replace(regexp_replace(text, '({_SEPARATOR})', '\1' || chr(1), 'g'),
 '(?i)(^|\x01)({'|'.join(REDACTED)})($|{_SEPARATOR})', '\1[PRÉNOM]\3', 'g'), chr(1), '') as text from documents""")
def redact_names(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", tx.redact(F.col("text"), REDACTED).alias("text"))


def escaped(text: str) -> str:
    for mark, entity in tx.HTML_ESCAPES:
        quoted = mark.replace("'", "''")
        text = f"replace({text}, '{quoted}', '{entity}')"
    return text


@query(f"""select doc_id, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as preview,
 {escaped("substr(text, 1, 120)")} as escaped from documents""")
def preview_text(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select(
        "doc_id", tx.preview(text, 200).alias("preview"), tx.html_escape(F.substring(text, 1, 120)).alias("escaped")
    )


@query(r"""with p as (select doc_id, case when lang = 'en' then 'RT @' || source || ' ' || text else '@' || lang || ' @' || source || ' ' || text end as raw from documents)
 select doc_id, starts_with(raw, 'RT @') as is_retweet, trim(regexp_replace(raw, '^(@[\p{L}\p{N}_]+\s*)+', '')) as text from p""")
def mention_strip(t: Tables) -> DataFrame:
    raw = F.when(F.col("lang") == "en", F.concat(F.lit("RT @"), "source", F.lit(" "), "text")).otherwise(
        F.concat(F.lit("@"), "lang", F.lit(" @"), "source", F.lit(" "), "text"))
    return t.documents.select("doc_id", raw.startswith("RT @").alias("is_retweet"), tx.strip_mentions(raw).alias("text"))


@query("""select c_custkey, lower(c_name) as label from customer""")
def label_from_id(t: Tables) -> DataFrame:
    folder = F.concat("c_name", F.lit("_"), F.lpad(F.col("c_custkey").cast("string"), 12, "4"))
    return t.customer.select("c_custkey", titles.label_from_id(folder).alias("label"))


_CASES = " ".join(
    f"when {' or '.join(f'contains(lower(p_name), {chr(39)}{w}{chr(39)})' for w in words)} then '{name}'"
    for name, words in PRODUCT_RULES.items()
)


@query(f"select p_partkey, case {_CASES} else 'other' end as category from part")
def product_category(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.category_of(F.col("p_name"), PRODUCT_RULES).alias("category"))


@query("""select p_partkey, case when p_size > 10 then 'series' else 'movie' end as content_type,
 case when p_size > 10 then p_name else p_name || ' the film' end as show_title, case when p_size > 10 and p_size <= 40 then p_size end::varchar as season,
 case when p_size > 10 then p_type end as episode_title from part""")
def title_parse(t: Tables) -> DataFrame:
    title = (
        F.when(F.col("p_size") <= 10, F.concat("p_name", F.lit(" the film")))
        .when(F.col("p_size") <= 40, F.concat("p_name", F.lit(": Saison "), "p_size", F.lit(": "), "p_type"))
        .otherwise(F.concat("p_name", F.lit(": "), "p_type"))
    )
    parsed = t.part.select("p_partkey", *[c.alias(n) for n, c in titles.title_parts(title).items()])
    return parsed.withColumn("season", F.col("season").cast("string"))


@query("""select p_partkey, split_part(p_type || '|' || p_brand, '|', 1) as first_genre, p_type || ', ' || p_brand as genres,
 regexp_replace(lower(p_brand), '[^a-z0-9 ]', '', 'g') as normalised from part""")
def list_strings(t: Tables) -> DataFrame:
    listed = F.concat("p_type", F.lit("|"), "p_brand")
    return t.part.select(
        "p_partkey", nested.first_of_list(listed).alias("first_genre"),
        F.array_join(F.split(listed, r"\|"), ", ").alias("genres"), tx.normalise_title(F.col("p_brand")).alias("normalised"),
    )


# ---- urls and pages

@query(r"""with u as (select page_id, url, url || '&q=' || replace(regexp_extract(url, '//([^/]+)', 1), '.', '+') || '&v=abcdefghi_' || (page_id % 10) as full_url,
 'https://t.example.com/@me/video/' || page_id as clip from pages)
 select page_id, regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1) as domain, replace(regexp_extract(url, '//([^/]+)', 1), '.', ' ') as search,
 'abcdefghi_' || (page_id % 10) as video, page_id::varchar as clip, regexp_extract(url, '[?&]page=([^&#]+)', 1) as page from u""")
def url_parts(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "//([^/]+)", 1)
    video = F.concat(F.lit("abcdefghi_"), F.col("page_id") % 10)
    full = F.concat("url", F.lit("&q="), F.replace(host, F.lit("."), F.lit("+")), F.lit("&v="), video)
    clip = F.concat(F.lit("https://t.example.com/@me/video/"), "page_id")
    return t.pages.select(
        "page_id", urls.domain(F.col("url")).alias("domain"), urls.search_query(full).alias("search"),
        urls.video_id(full).alias("video"), urls.clip_id(clip).alias("clip"), urls.query_value(F.col("url"), "page").alias("page"),
    )


@query(r"select regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1) as domain, count(*) as n from pages group by domain")
def domain_counts(t: Tables) -> DataFrame:
    return t.pages.groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(r"""select page_id, '/assets/' || replace(url_encode(regexp_replace(url, '^https?://[^/]+/', '')), '%2F', '/') as path from pages""")
def path_rewrite(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.rewrite_root(F.col("url"), "^https?://[^/]+/", "/assets/").alias("path"))


def unescaped(text: str) -> str:
    text = f"replace(replace({text}, '&nbsp;', ' '), '&#39;', '''')"
    for mark, entity in reversed(tx.HTML_ESCAPES):
        quoted = mark.replace("'", "''")
        text = f"replace({text}, '{entity}', '{quoted}')"
    return text


def plain_sql(html: str) -> str:
    return f"trim({unescaped(f'regexp_replace({html}, {chr(39)}(?s)<[^>]*>{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')})"


_LINK = r'(?s)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


@query(f"""with l as (select page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) as h, unnest(regexp_extract_all(html, '{_LINK}', 2)) as x,
 unnest(range(len(regexp_extract_all(html, '{_LINK}')))) as pos from pages)
 select page_id, pos::int as pos, {unescaped('h')} as href, {plain_sql('x')} as link_text from l""")
def html_links(t: Tables) -> DataFrame:
    found = t.pages.select("page_id", F.posexplode(activity_html.links(F.col("html"))).alias("pos", "link"))
    return found.select("page_id", "pos", "link.href", F.col("link.text").alias("link_text"))


@query(f"""select page_id, {plain_sql("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")} as title from pages""")
def html_title(t: Tables) -> DataFrame:
    return t.pages.select("page_id", activity_html.page_title(F.col("html")).alias("title"))


_HOSTS = {"MOBILE": r"(?i)^m\.", "BLOG": r"(?i)^blog\.", "SPAM": r"(?i)^spam"}
_HOST_CASE = "case " + " ".join(f"when regexp_matches(domain, '{p}') then '{n}'" for n, p in _HOSTS.items()) + " end"


@query(rf"""with d as (select page_id, regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1) as domain, regexp_replace(url, '^https?://[^/]+/', '') as rest from pages)
 select page_id, coalesce({_HOST_CASE}, 'OTHER') as source, regexp_replace(rest, '^(en|fr)/', '') as target from d""")
def source_routing(t: Tables) -> DataFrame:
    source = F.coalesce(manifest.source_of(urls.domain(F.col("url")), _HOSTS), F.lit("OTHER"))
    inside = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+/", ""), "^(en|fr)/", "")
    return t.pages.select("page_id", source.alias("source"), inside.alias("target"))


_NAMES = sorted(manifest.EXTENSIONS)


@query(rf"""with f as (select ([{sql_list(_NAMES)}])[page_id % {len(_NAMES)} + 1] as source, regexp_extract(url, 'https?://(?:www\.)?([^/]+)', 1) as folder,
  lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '(\.[^./]+)$', 1)) as extension, case when length(html) < 2500 then 0 else length(html) end as size from pages),
 k as ({" union all ".join(f"select '{n}' as source, '{e}' as extension, true as known" for n, kinds in manifest.EXTENSIONS.items() for e in kinds)}),
 c as (select source, folder, count(*) as files, coalesce(bool_or(known), false) as known, count(*) filter (where size = 0) as empty from f left join k using (source, extension) group by all)
 select source, folder, files, 'warning' as level, 'no expected extension' as problem from c where not known
 union all select source, folder, files, 'error', 'empty file' from c where empty > 0""")
def manifest_check(t: Tables) -> DataFrame:
    """Pages are the files of an export: hosts its folders, small pages empty files."""
    source = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("page_id") % len(_NAMES)).cast("int"))
    inside = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    size = F.when(F.length("html") < 2500, 0).otherwise(F.length("html"))
    return manifest.findings(t.pages.select(source.alias("source"), urls.domain(F.col("url")).alias("folder"), inside.alias("inside"), size.alias("size")))


@query("""select lang, source, doc_id from (select *, row_number() over (partition by lang, text order by case when lang = 'en' then -doc_id else doc_id end) as rn
 from documents) where rn = 1""")
def snapshot_precedence(t: Tables) -> DataFrame:
    """Of equal texts in a language one stays: the latest in English, the first elsewhere."""
    files = t.documents.select(
        "lang", "source", "doc_id", F.sha2("text", 256).alias("digest"), (F.col("lang") == "en").alias("latest")
    )
    return surviving_versions(files, ["lang", "digest"], "doc_id", "latest", "source").select("lang", "source", "doc_id")


# ---- nested values

@query("""select event_id, json_extract_string(props, '$.k')::int as k, coalesce(json_extract_string(props, '$.missing'), 'none') as missing,
 json_extract_string(props, '$.k') is not null or json_extract_string(props, '$.missing') is not null as has_any from events""")
def json_props(t: Tables) -> DataFrame:
    props = F.col("props")
    return t.events.select(
        "event_id", nested.json_value(props, "$.k").cast("int").alias("k"),
        nested.json_value(props, "$.missing", "none").alias("missing"),
        F.coalesce(nested.json_value(props, "$.k"), nested.json_value(props, "$.missing")).isNotNull().alias("has_any"),
    )


@query("""select event_id, json_extract_string(props, '$.k')::int as k from events""")
def js_wrapped_json(t: Tables) -> DataFrame:
    wrapped = F.concat(F.lit("window.YTD.events.part0 = ["), "props", F.lit("]"))
    items = F.from_json(nested.unwrap_js(wrapped), "array<struct<k:int>>")
    return t.events.select("event_id", F.explode(items).alias("i")).select("event_id", "i.k")


@query("""select conv_id, turn, role as list_name, unnest(string_split(text, chr(10))) as item from conversations""")
def nested_explode(t: Tables) -> DataFrame:
    """Lists holding items, written as one JSON document per row and opened again."""
    items = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("line")))
    document = F.to_json(F.struct(F.array(F.struct(F.col("role").alias("name"), items.alias("items"))).alias("playlists")))
    schema = "playlists array<struct<name:string,items:array<struct<line:string>>>>"
    opened = t.conversations.select("conv_id", "turn", F.explode(F.from_json(document, schema)["playlists"]).alias("p"))
    rows = opened.select("conv_id", "turn", F.col("p.name").alias("list_name"), F.explode("p.items").alias("i"))
    return rows.select("conv_id", "turn", "list_name", F.col("i.line").alias("item"))


@query("""select event_id::varchar as track_id, unnest([event_type, 'k' || json_extract_string(props, '$.k')]) as tag from events
 where event_type <> 'error'""")
def json_map_explode(t: Tables) -> DataFrame:
    """Tag replies, fenced, some of them not JSON at all."""
    tags = F.array("event_type", F.concat(F.lit("k"), nested.json_value(F.col("props"), "$.k")))
    body = F.to_json(F.create_map(F.col("event_id").cast("string"), tags))
    reply = F.when(F.col("event_type") == "error", "sorry, no tags").otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    pairs = t.events.select(F.explode(nested.reply_tags(reply)).alias("track_id", "tags"))
    return pairs.select("track_id", F.explode("tags").alias("tag"))


@query(r"""with w as (select doc_id, list_filter(string_split_regex(text, '\s'), lambda x: x <> '') as words from documents)
 select doc_id, array_to_string(words[1:30], ' ') as first_words, words[-1] as last_word, len(words)::int as n from w""")
def array_caps(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", nested.without_empty(F.split("text", r"\s")).alias("words"))
    return words.select(
        "doc_id", F.array_join(F.slice("words", 1, 30), " ").alias("first_words"),
        F.try_element_at("words", F.lit(-1)).alias("last_word"), F.size("words").alias("n"),
    )


@query(r"""with w as (select doc_id, string_split_regex(lower(text), '\s') as body, [lang, source, lang] as head from documents),
 u as (select doc_id, unnest(list_concat(head, body)) as term, unnest(range(len(head) + len(body))) as pos from w),
 f as (select doc_id, term, min(pos) as pos from u group by all)
 select doc_id, string_agg(term, ' ' order by pos) as merged from f group by doc_id""")
def keyword_merge(t: Tables) -> DataFrame:
    merged = nested.ordered_union(F.array("lang", "source", "lang"), F.split(F.lower("text"), r"\s"))
    return t.texts.select("doc_id", F.array_join(merged, " ").alias("merged"))


# ---- word statistics

_COUNTABLE = r"length(text) > 2 and not regexp_matches(text, '@|^https?://|%[0-9a-fA-F]{2}')"
_TOKENS = r"string_split_regex(regexp_replace(lower(text), '\s+$', ''), '\s')"


def unigram_sql(*keep: str) -> str:
    columns = "".join(f"{k}, " for k in keep)
    return rf"""(select * from (select {columns}unnest({_TOKENS}) as term from documents where {_COUNTABLE})
 where length(term) > 2 and not regexp_matches(term, '^\d') and not regexp_matches(term, '[@%#\(\)]') and term not in ({sql_list(STOP_WORDS)}))"""


def bigram_sql(*keep: str) -> str:
    columns = "".join(f"{k}, " for k in keep)
    return rf"""(select {columns}term from (select {columns}unnest(list_transform(range(1, greatest(len(kept), 1)), lambda i: kept[i] || ' ' || kept[i + 1])) as term
 from (select {columns}list_filter({_TOKENS}, lambda w: w not in ({sql_list(STOP_WORDS)})) as kept from documents where {_COUNTABLE}))
 where length(term) > 5 and not regexp_matches(term, '[@%#\(\)\d]'))"""


@query(f"""select lang, term, n, rank::int as rank from (select lang, term, count(*) as n, row_number() over (partition by lang order by count(*) desc, term) as rank
 from {unigram_sql('lang')} group by lang, term) where rank <= 20""")
def top_unigrams(t: Tables) -> DataFrame:
    return terms.top_counts(terms.term_counts(t.texts, ["lang"], "text", STOP_WORDS, 1, 20), ["lang"], 20)


@query(f"""select lang, term, n, rank::int as rank from (select lang, term, count(*) as n, row_number() over (partition by lang order by count(*) desc, term) as rank
 from {bigram_sql('lang')} group by lang, term) where rank <= 10""")
def top_bigrams(t: Tables) -> DataFrame:
    return terms.top_counts(terms.term_counts(t.texts, ["lang"], "text", STOP_WORDS, 2, 10), ["lang"], 10)


# One rule needs a back-reference, which the comparison engine has not; it matches no text of the given tables.
_NOISE_SQL = f"regexp_matches(text, '{tx.TITLE_NOISE.removesuffix(tx.REPEATED_DOMAIN).replace('(?iU)', '(?i)')}')"


@query(rf"""select lang, sha256(text) as digest, n, rank::int as rank, text from (select lang, text, count(*) as n,
 row_number() over (partition by lang order by count(*) desc, sha256(text)) as rank from documents where length(text) > 1
 and not regexp_matches(text, '@|^https?://|%[0-9a-fA-F]{{2}}') and not ({_NOISE_SQL}) and not regexp_matches(text, '^\s*[A-Z0-9_]{{5,}}\s')
 group by lang, text) where rank <= 5""")
def top_samples(t: Tables) -> DataFrame:
    return terms.top_texts(t.texts, ["lang"], "text", 5)


@query(f"""with used as (select lang, source, row_number() over (partition by lang order by source) as place from (select distinct lang, source from documents)),
 b as (select lang, source, term, row_number() over (partition by lang, source order by count(*) desc, term) as rank from {bigram_sql('lang', 'source')} group by lang, source, term),
 u as (select lang, source, term, row_number() over (partition by lang, source order by count(*) desc, term) as rank from {unigram_sql('lang', 'source')} group by lang, source, term),
 c as (select *, 0 as kind from b where rank <= 4 union all select *, 1 from u where rank <= 12),
 o as (select lang, term, place, kind, rank, row_number() over (partition by lang, term order by place, kind, rank) as seen from c join used using (lang, source))
 select lang, string_agg(term, ';' order by place, kind, rank) as keywords from o where seen = 1 group by lang""")
def keyword_profiles(t: Tables) -> DataFrame:
    made = terms.keyword_profiles(t.texts, "lang", "source", "text", STOP_WORDS)
    return made.select("lang", F.array_join("keywords", ";").alias("keywords"))


def _categories(test) -> str:
    return " union all ".join(f"select '{n}' as category, count(*) filter (where {test(w)}) as score from documents" for n, w in CATEGORIES.items())


@query(_categories(lambda words: f"regexp_matches(lower(text), '(^|[^a-z])({'|'.join(words)})($|[^a-z])')"))
def category_scores(t: Tables) -> DataFrame:
    return terms.category_scores(t.texts, "text", CATEGORIES)


@query(f"""select category, score as n, round(100.0 * score / (select count(*) from documents), 6) as pct from
 ({_categories(lambda words: ' or '.join(f"contains(lower(text), '{w}')" for w in words))}) where score > 0""")
def category_substring(t: Tables) -> DataFrame:
    return terms.category_mentions(t.documents, "text", CATEGORIES)


_MARKER_SQL = " union all ".join(f"select '{m}' as marker, sum({word_hits('text', [m])})::bigint as n from documents" for m in MARKERS)


@query(f"select * from ({_MARKER_SQL}) where n > 0 order by n desc, marker limit 8")
def tic_counts(t: Tables) -> DataFrame:
    return terms.marker_counts(t.texts, "text", MARKERS, 8)


@query(f"""with w as (select doc_id, term, count(*) as tf from {unigram_sql('doc_id')} group by all),
 d as (select term, count(*) as df from w group by term),
 x as (select doc_id, term, tf, df, round(tf * ln(((select count(*) from documents) + 1) / (df + 1)), 6) as weight from w join d using (term))
 select doc_id, term, tf, df, weight, rank::int as rank from (select *, row_number() over (partition by doc_id order by weight desc, term) as rank from x) where rank <= 3""")
def tfidf_terms(t: Tables) -> DataFrame:
    return terms.tfidf(t.texts.select("doc_id", "text"), "doc_id", "text", STOP_WORDS, 3)


@query()
def content_clusters(t: Tables) -> DataFrame:
    return terms.content_clusters(t.texts.select("doc_id", "text"), "doc_id", "text", STOP_WORDS, 6)
