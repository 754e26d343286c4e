"""Report sections over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.operators import ordered, report
from activity_engine.plans.params import CATEGORIES, MARKERS
from activity_engine.plans.registry import Tables, query
from activity_engine.plans.text_queries import hits, word_hits
from activity_engine.plans.window_queries import session_sql


def _metric(section: str, metric: str, value: str, source: str) -> str:
    return f"select '{section}' as section, '{metric}' as metric, '' as key, round(({value})::double, 4) as value from {source}"


def _top(section: str, metric: str, key: str, source: str, n: int) -> str:
    return f"""select * from (select '{section}' as section, '{metric}' as metric, {key}::varchar as key, count(*)::double as value
 from {source} group by {key} order by count(*) desc, {key} limit {n})"""


_MARKED = "(" + " or ".join(f"contains(lower(text), '{m}')" for m in MARKERS[:4]) + ")"
_TICS = " union all ".join(f"select '{m}' as m, sum({word_hits('text', [m])}) as n from conversations" for m in MARKERS)
_EVENTS = "(select * from events where ts between timestamp '2024-01-05' and timestamp '2024-01-25')"


@query(" union all ".join([
    _metric("words", "messages", "count(*)", "conversations"),
    _metric("words", "avg_chars", "avg(length(text))", "conversations"),
    _metric("words", "avg_words", f"avg({hits('text', chr(92) + 'S+')})", "conversations"),
    _metric("words", "reasoning", f"count(*) filter (where {_MARKED})", "conversations"),
    _metric("words", "reasoning_pct", f"100.0 * count(*) filter (where {_MARKED}) / count(*)", "conversations"),
    _metric("words", "deep_sessions", "count(*)", f"({session_sql('user_id', 'ts', _EVENTS, '24 hour')}) where n_events >= 15"),
    f"select * from (select 'words', 'tic', m, n::double from ({_TICS}) where n > 0 order by n desc, m limit 8)",
    f"""select * from (select 'words', 'sample', case when length(text) > 200 then substr(text, 1, 200) || '...' else text end, length(text)::double
 from conversations where {_MARKED} order by conv_id, turn limit 3)""",
]))
def report_words(t: Tables) -> DataFrame:
    dated = report.in_period(t.events, "ts", "2024-01-05", "2024-01-25")
    return report.words_section(
        t.conversations, "text", ["conv_id", "turn"], dated, "user_id", "ts", MARKERS[:4], MARKERS, gap_seconds=24 * 3600
    )


@query(" union all ".join([
    _metric("searches", "searches", "count(*)", "documents"),
    "select * from (" + " union all ".join(
        f"""select 'searches' as section, 'category' as metric, '{c}' as key, (count(*) filter (where
 {' or '.join(f"contains(lower(text), '{w}')" for w in words)}))::double as value from documents""" for c, words in CATEGORIES.items()) + ") where value > 0",
    """select 'searches', 'top', text, n::double from (select text, count(*) as n from documents group by text order by n desc, sha256(text) limit 15)""",
]))
def report_searches(t: Tables) -> DataFrame:
    return report.searches_section(t.documents, "text", CATEGORIES)


_PLAYS = "(select * from lineitem where l_shipdate between timestamp '1996-01-01' and timestamp '1998-12-31')"
_VIEWS = "(select * from orders where o_orderdate between timestamp '1996-01-01' and timestamp '1998-12-31')"


@query(" union all ".join([
    _metric("media", "plays", "count(*)", _PLAYS),
    _metric("media", "minutes", "sum(l_quantity::decimal(18,4))", _PLAYS),
    _metric("media", "night_pct", "100.0 * count(*) filter (where hour(l_shipdate) >= 22 or hour(l_shipdate) <= 5) / count(*)", _PLAYS),
    _top("media", "peak_hour", "hour(l_shipdate)", _PLAYS, 1),
    _top("media", "artist", "l_suppkey", _PLAYS, 10),
    _metric("media", "views", "count(*)", _VIEWS),
    _top("media", "busiest_week", "weekofyear(o_orderdate)", _VIEWS, 1),
    _top("media", "show", "o_custkey", _VIEWS, 10),
    _metric("media", "watches", "count(*)", _EVENTS),
    _metric("media", "watch_night_pct", "100.0 * count(*) filter (where hour(ts) between 0 and 5) / count(*)", _EVENTS),
]))
def report_media(t: Tables) -> DataFrame:
    plays = report.in_period(t.lineitem, "l_shipdate", "1996-01-01", "1998-12-31")
    views = report.in_period(t.orders, "o_orderdate", "1996-01-01", "1998-12-31")
    watches = report.in_period(t.events, "ts", "2024-01-05", "2024-01-25")
    return report.media_section(
        plays, "l_shipdate", "l_suppkey", F.col("l_quantity").cast("decimal(18,4)"), views, "o_orderdate", "o_custkey", watches, "ts"
    )


_BOUGHT = "(select * from lineitem join part on p_partkey = l_partkey)"


@query(" union all ".join([
    _metric("purchases", "orders", "count(*)", _BOUGHT),
    _metric("purchases", "spent", "sum(l_extendedprice::decimal(18,4))", _BOUGHT),
    _top("purchases", "category", "p_type", _BOUGHT, 10),
    _top("purchases", "product", "p_name", _BOUGHT, 8),
]))
def report_purchases(t: Tables) -> DataFrame:
    titles = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    bought = t.lineitem.select("l_partkey", "l_extendedprice").join(titles, "l_partkey")
    return report.purchases_section(bought, "l_extendedprice", "p_type", "p_name")


@query("""select p_type as category, count(*) as orders, sum(l_extendedprice::decimal(18,4))::double as spent from lineitem join part on p_partkey = l_partkey
 group by p_type""")
def spend_summary(t: Tables) -> DataFrame:
    titles = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    # Lines are first summed per item, so the lookup joins a row per item rather than a row per line.
    items = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("orders"), F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("spent"))
    return items.join(titles, "l_partkey").groupBy(F.col("p_type").alias("category")).agg(
        F.sum("orders").alias("orders"), F.sum("spent").cast("double").alias("spent")
    )


@query("""select l_partkey, p_name, n from (select l_partkey, count(*) as n from lineitem group by l_partkey order by n desc, l_partkey limit 8)
 join part on p_partkey = l_partkey""")
def top_products(t: Tables) -> DataFrame:
    best = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(8)
    titles = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return best.join(titles, "l_partkey").select("l_partkey", "p_name", "n")


@query("""select *, row_number() over (order by date, section) - 1 as place from (select case when event_type = 'error' then null else ts end as date, 'watch' as section from events
 union all select o_orderdate, 'purchases' from orders union all select l_shipdate, 'media' from lineitem) where date is not null""")
def report_timeline(t: Tables) -> DataFrame:
    watched = t.events.select(F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"))
    return ordered.places(report.timeline({"watch": (watched, "ts"), "purchases": (t.orders, "o_orderdate"), "media": (t.lineitem, "l_shipdate")}))
