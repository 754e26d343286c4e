"""Sessions, runs, gaps, ranks, best rows per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.functions import calendar as cal
from activity_engine.operators import ordered, reco, select
from activity_engine.operators.sessions import sessions as gap_sessions
from activity_engine.plans.registry import Tables, query


def session_sql(owner: str, ts: str, table: str, gap: str) -> str:
    """Sessions of a table as a SQL query: owner, session_no, start_ts, end_ts, n_events, mid_ts."""
    return f"""with g as (select {owner}, {ts} as ts, case when {ts} - lag({ts}) over (partition by {owner} order by {ts}) > interval {gap}
  then 1 else 0 end as starts from {table}),
 s as (select *, sum(starts) over (partition by {owner} order by ts) as session_no from g)
 select {owner}, session_no::bigint as session_no, min(ts) as start_ts, max(ts) as end_ts, count(*) as n_events,
 make_timestamp((epoch_us(min(ts)) + floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 2))::bigint) as mid_ts from s group by {owner}, session_no"""


@query(session_sql("user_id", "ts", "events", "6 hour"))
def sessions(t: Tables) -> DataFrame:
    return gap_sessions(t.events, "user_id", "ts", 6 * 3600)


@query(f"select user_id, session_no, n_events from ({session_sql('user_id', 'ts', 'events', '12 hour')}) where n_events >= 5")
def deep_sessions(t: Tables) -> DataFrame:
    found = gap_sessions(t.events, "user_id", "ts", 12 * 3600).filter("n_events >= 5")
    return found.select("user_id", "session_no", "n_events")


@query(f"""select user_id, session_no, case when hour(start_ts) < 6 then 'Nuit' when hour(start_ts) < 12 then 'Matin'
 when hour(start_ts) < 18 then 'Après-midi' when hour(start_ts) < 23 then 'Soirée' else 'Nuit' end || ' · ' || day(start_ts) || ' '
 || (['jan', 'fév', 'mar', 'avr', 'mai', 'juin', 'juil', 'août', 'sep', 'oct', 'nov', 'déc'])[month(start_ts)] || ' ' || year(start_ts) as name
 from ({session_sql('user_id', 'ts', 'events', '6 hour')})""")
def scene_label(t: Tables) -> DataFrame:
    found = gap_sessions(t.events, "user_id", "ts", 6 * 3600)
    return found.select("user_id", "session_no", cal.scene_label(F.col("start_ts")).alias("name"))


@query("""select user_id, event_id, round((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1000000.0, 6)
 as gap_seconds from events""")
def inter_event_gap(t: Tables) -> DataFrame:
    events = t.events.select("user_id", "ts", "event_id")
    rows = ordered.OrderedRows(events, ["user_id"], ["ts", "event_id"]).lag(F.col("ts"), "before").result()
    gap = (cal.epoch_micros(F.col("ts")) - cal.epoch_micros(F.col("before"))) / 1_000_000
    return rows.select("user_id", "event_id", F.round(gap, 6).alias("gap_seconds"))


@query("""with l as (select *, lag(event_type) over w as before from events window w as (partition by user_id order by ts, event_id)),
 r as (select *, sum(case when before is not null and before <> event_type then 1 else 0 end) over (partition by user_id order by ts, event_id) as run_no from l)
 select user_id, run_no::bigint as run_no, event_type, min(ts) as start_ts, max(ts) as end_ts, count(*) as n from r group by all""")
def event_runs(t: Tables) -> DataFrame:
    events = t.events.select("user_id", "ts", "event_id", "event_type")
    runs = ordered.number_runs(events, ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "run_no", "event_type").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n")
    )


@query("""with f as (select user_id, props as item, min(ts) as first_ts from events group by all)
 select user_id, item, first_ts, row_number() over (partition by user_id order by first_ts, item) - 1 as rank from f""")
def playlist_rank(t: Tables) -> DataFrame:
    """Items of an owner in the order first met, each once."""
    firsts = t.events.groupBy("user_id", F.col("props").alias("item")).agg(F.min("ts").alias("first_ts"))
    return ordered.dense_position(firsts, ["user_id"], ["first_ts", "item"], "rank")


# Kinds of event from the richest to the poorest.
_KINDS = ("purchase", "signup", "view", "click", "error")
_KIND_SQL = "case event_type " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(_KINDS)) + " end"


@query(f"""select event_id, user_id, hour_ts, event_type, value from (select *, date_trunc('hour', ts)::timestamp as hour_ts,
 row_number() over (partition by user_id, date_trunc('hour', ts) order by {_KIND_SQL}, ts, event_id) as rn from events) where rn = 1""")
def priority_dedupe(t: Tables) -> DataFrame:
    """One event per owner and hour, the richest kind."""
    priority = F.lit(len(_KINDS))
    for i, kind in enumerate(_KINDS):
        priority = F.when(F.col("event_type") == kind, i).otherwise(priority)
    events = t.events.select(
        "event_id", "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_ts"), "event_type", "value", "ts",
        priority.alias("priority"),
    )
    return select.first_per_key(events, ["user_id", "hour_ts"], ["priority", "ts", "event_id"]).drop("ts", "priority")


@query("""select user_id, event_id, value, rank::int as rank from (select *, row_number() over (partition by user_id order by value desc, event_id) as rank
 from events) where rank <= 5""")
def topk_per_group(t: Tables) -> DataFrame:
    events = t.events.select("user_id", "event_id", "value")
    return select.top_per_group(events, ["user_id"], [F.desc("value"), F.col("event_id")], 5)


@query("""select event_id, event_type from (select *, row_number() over (partition by event_type order by event_id) as rn from events) where rn <= 500""")
def capped_sources(t: Tables) -> DataFrame:
    return select.capped_per_source(t.events.select("event_id", "event_type"), "event_type", "event_id", 500)


@query("""select conv_id, row_number() over (order by md5('42:' || conv_id), conv_id) - 1 as place from (select distinct conv_id from conversations)""")
def shuffled_examples(t: Tables) -> DataFrame:
    return ordered.places(select.shuffled(t.conversations.select("conv_id").distinct(), "conv_id", 42))


@query("""select o_custkey, o_orderkey, o_orderdate, o_totalprice from (select *, row_number() over (partition by o_custkey
 order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1""")
def latest_per_key(t: Tables) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return select.latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""select o_custkey, string_agg(strftime(o_orderdate, '%Y-%m-%d'), ',' order by o_orderdate desc, o_orderkey desc) as dates from (
 select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn <= 8 group by o_custkey""")
def last_dates(t: Tables) -> DataFrame:
    """Dates of the last eight orders, latest first."""
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    last = select.top_per_group(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 8)
    dates = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")))), lambda x: x["d"]
    )
    return last.groupBy("o_custkey").agg(F.array_join(dates, ",").alias("dates"))


@query("""with p as (select user_id, event_id, round(100 * percent_rank() over (partition by user_id order by value), 6) as score from events)
 select *, case when score >= 85 then 'will love' when score >= 70 then 'will probably like' when score >= 50 then 'might like'
 when score >= 30 then 'will like little' else 'will not like' end as label from p""")
def percent_rank_score(t: Tables) -> DataFrame:
    ranked = ordered.percent_rank(t.events.select("user_id", "event_id", "value"), ["user_id"], "value", "pct")
    scored = ranked.select("user_id", "event_id", F.round(F.col("pct") * 100, 6).alias("score"))
    return scored.withColumn("label", reco.score_band(F.col("score"), reco.SCORE_LABELS))


@query("""with b as (select p_brand, min(p_retailprice) as low, max(p_retailprice) as high from part group by p_brand)
 select p_partkey, p_brand, round(case when high = low then 100.0 else 100.0 * (p_retailprice - low) / (high - low) end, 4) as score
 from part join b using (p_brand)""")
def minmax_score(t: Tables) -> DataFrame:
    parts = t.part.select("p_partkey", "p_brand", "p_retailprice")
    return reco.minmax_score(parts, ["p_brand"], "p_retailprice").drop("p_retailprice")


@query("""with c as (select o_custkey, count(*) as n from orders group by o_custkey)
 select o_custkey, n, rank::int as rank, round(n::double / max(n) over (), 6) as relative from (
 select c.*, row_number() over (partition by c_mktsegment order by n desc, o_custkey) as rank from c join customer on c_custkey = o_custkey)""")
def group_sizes(t: Tables) -> DataFrame:
    """Orders per customer, the rank of that count within the segment, and its size relative to the largest."""
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    segments = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    placed = counts.join(segments, "o_custkey").withColumn("_order", -F.col("n"))
    ranked = ordered.dense_position(placed, ["c_mktsegment"], ["_order", "o_custkey"], "rank")
    largest = counts.agg(F.max("n")).scalar()
    return ranked.select(
        "o_custkey", "n", (F.col("rank") + 1).cast("int").alias("rank"), F.round(F.col("n") / largest, 6).alias("relative")
    )
