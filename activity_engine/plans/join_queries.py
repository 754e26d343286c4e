"""Enrichment, time joins, cascades, anti joins and title lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.functions.nested import json_value
from activity_engine.operators import album, lookups, select, terms, timejoins
from activity_engine.operators.sessions import sessions
from activity_engine.plans.params import CATEGORIES, WANTED_TITLES
from activity_engine.plans.registry import Tables, query, sql_list
from activity_engine.plans.window_queries import session_sql


def _of_type(t: Tables, kind: str) -> DataFrame:
    return t.events.filter(F.col("event_type") == kind)


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, p_type from lineitem left join
 (select * from part where p_size <= 25) on l_partkey = p_partkey""")
def left_enrich(t: Tables) -> DataFrame:
    known = t.part.filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.join(known, "l_partkey", "left")


@query("""select p.event_id, count(v.event_id) as n from (select * from events where event_type = 'purchase') p
 left join (select * from events where event_type = 'view') v on p.user_id = v.user_id
 and v.ts between p.ts - interval 6 hour and p.ts + interval 6 hour group by p.event_id""")
def interval_join(t: Tables) -> DataFrame:
    """Views within six hours of each purchase of the same owner."""
    purchases = _of_type(t, "purchase").select("user_id", "event_id", "ts")
    views = _of_type(t, "view").select("user_id", "ts")
    counted = timejoins.window_counts(purchases, views, ["user_id"], ["event_id"], "ts", 6 * 3600)
    return counted.select("event_id", "n")


@query(f"""with s as ({session_sql("user_id", "ts", "(select * from events where event_type = 'purchase')", "6 hour")})
 select s.user_id, session_no, event_id, e.ts, row_number() over (partition by s.user_id, session_no order by e.ts, event_id) - 1 as rank
 from s join events e on e.user_id = s.user_id and event_type = 'view'
 and e.ts between start_ts - interval 1 hour and end_ts + interval 1 hour""")
def scene_playlist(t: Tables) -> DataFrame:
    """Views around each purchase session, in order."""
    spans = sessions(_of_type(t, "purchase"), "user_id", "ts", 6 * 3600)
    plays = _of_type(t, "view").select("user_id", "event_id", "ts")
    return album.scene_playlist(spans, plays, "user_id", "session_no", "ts", "event_id")


@query("""with p as (select user_id, event_id, ts from events where event_type = 'purchase'),
 v as (select user_id, event_id as mark_id, ts from events where event_type = 'signup'),
 j as (select p.user_id, p.event_id, v.mark_id, abs(epoch_us(p.ts) - epoch_us(v.ts)) as d,
  row_number() over (partition by p.event_id order by abs(epoch_us(p.ts) - epoch_us(v.ts)), v.mark_id) as rn from p left join v on p.user_id = v.user_id)
 select user_id, event_id, mark_id::varchar as mark_id, round(d / 1000000.0, 6) as distance_seconds from j where rn = 1""")
def nearest_time(t: Tables) -> DataFrame:
    purchases = _of_type(t, "purchase").select("user_id", "event_id", "ts")
    marks = _of_type(t, "signup").select("user_id", F.col("event_id").alias("mark_id"), "ts")
    found = timejoins.nearest_in_time(purchases, marks, ["user_id"], "event_id", "mark_id", "ts")
    return found.withColumns({
        "mark_id": F.col("mark_id").cast("string"), "distance_seconds": F.round("distance_seconds", 6)
    })


_CASCADE = """with photos as (select user_id, event_id, ts, hour(ts) as h from events where event_type = 'purchase'),
 plays as (select user_id, ts, json_extract_string(props, '$.k')::int as track, hour(ts) as h, value from events where event_type = 'view'),
 fixed as (select event_id + 1 as event_id, min(json_extract_string(props, '$.k')::int) as track from events where event_type = 'signup' group by 1),
 near as (select event_id, track, n from (select event_id, track, count(*) as n, row_number() over (partition by event_id order by count(*) desc, track) as rn
  from photos p join plays v on p.user_id = v.user_id and v.ts between p.ts - interval 1 hour and p.ts + interval 1 hour group by event_id, track) where rn = 1),
 wide as (select event_id, track, n from (select event_id, track, count(*) as n, row_number() over (partition by event_id order by count(*) desc, track) as rn
  from photos p join plays v on p.user_id = v.user_id and v.ts between p.ts - interval 3 hour and p.ts + interval 3 hour group by event_id, track) where rn = 1),
 pricey as (select event_id, track, 0.9::double as score from (select p.event_id, l.track, row_number() over (partition by p.event_id order by l.track) as rn
  from photos p join events e on e.event_id = p.event_id join (select distinct track from plays where value >= 60) l
  on l.track = json_extract_string(e.props, '$.k')::int) where rn = 1),
 hourly as (select h, track, share from (select h, track, count(*)::double / sum(count(*)) over (partition by h) as share,
  row_number() over (partition by h order by count(*) desc, track) as rn from plays group by h, track) where rn = 1 and share >= 0.05),
 favourite as (select user_id, track from (select user_id, track, row_number() over (partition by user_id order by count(*) desc, track) as rn
  from plays where track is not null group by user_id, track) where rn = 1),
 m as (select p.user_id, p.event_id, case when f.track is not null then 'manual' when n.track is not null then 'temporal'
  when c.track is not null then 'semantic' when h.track is not null then 'semantic' when w.track is not null then 'temporal'
  when b.track is not null then 'fallback' else 'none' end as match_type,
  coalesce(f.track, n.track, c.track, h.track, w.track, b.track) as track,
  round(case when f.track is not null then 1.0 when n.track is not null then n.n when c.track is not null then c.score
  when h.track is not null then h.share when w.track is not null then w.n when b.track is not null then 0 end::double, 6) as match_score
  from photos p left join fixed f using (event_id) left join near n using (event_id) left join pricey c using (event_id)
  left join hourly h on h.h = p.h left join wide w using (event_id) left join favourite b on b.user_id = p.user_id)"""


def _matches(t: Tables) -> DataFrame:
    """Purchases are the photos, views the plays; signups pin a track to the event after them."""
    track = json_value(F.col("props"), "$.k").cast("int")
    photos = _of_type(t, "purchase").select("user_id", "event_id", "ts", track.alias("_tag"))
    plays = _of_type(t, "view").select("user_id", "ts", track.alias("track"), "value")
    pinned = _of_type(t, "signup").select((F.col("event_id") + 1).alias("event_id"), track.alias("track"))
    overrides = photos.select("user_id", "event_id").join(pinned, "event_id")
    library = plays.filter("value >= 60").select("track").distinct()
    by_text = photos.join(library, F.col("_tag") == F.col("track")).select("user_id", "event_id", "track", F.lit(0.9).alias("match_score"))
    hourly = plays.groupBy(F.hour("ts").alias("h"), "track").agg(F.count("*").alias("n"))
    totals = hourly.groupBy("h").agg(
        F.min_by(F.struct("track", "n"), F.struct(-F.col("n"), F.col("track"))).alias("b"), F.sum("n").alias("total")
    ).select("h", "b.track", (F.col("b.n") / F.col("total")).alias("match_score")).filter("match_score >= 0.05")
    by_context = photos.withColumn("h", F.hour("ts")).join(totals, "h").select("user_id", "event_id", "track", "match_score")
    return album.match_music(
        photos.drop("_tag"), plays.drop("value"), overrides, by_text, by_context, "user_id", "event_id", "ts", "track"
    )


@query(_CASCADE + " select event_id, track, match_type, match_score from m")
def match_cascade(t: Tables) -> DataFrame:
    return _matches(t).select("event_id", "track", "match_type", F.round("match_score", 6).alias("match_score"))


@query(_CASCADE + """ select user_id, track, votes from (select user_id, track, count(*) as votes, row_number() over (partition by user_id
 order by count(*) desc, track) as rn from m where match_type in ('manual', 'temporal', 'semantic') group by user_id, track) where rn = 1""")
def scene_vote(t: Tables) -> DataFrame:
    return album.scene_votes(_matches(t), ["user_id"], "track")


@query(f"""with k as ({" union all ".join(f"select '{c}' as category, unnest([{sql_list(w)}]) as keyword" for c, w in CATEGORIES.items())}),
 seen as (select distinct source, word from (select source, unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) as word from documents))
 select s.source, k.category, k.keyword from (select distinct source from documents) s, k
 where not exists (select 1 from seen where seen.source = s.source and seen.word = k.keyword)""")
def category_gap(t: Tables) -> DataFrame:
    """Keywords that never occur in a source."""
    pairs = [(c, k) for c, words in CATEGORIES.items() for k in words]
    listed = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("keyword")) for c, k in pairs])
    wanted = t.documents.select("source").distinct().select("source", F.inline(listed))
    known = F.array(*[F.lit(k) for _, k in pairs])
    words = F.array_intersect(F.split(F.lower("text"), r"[^\p{L}]+"), known)
    seen = t.documents.select("source", F.explode(words).alias("keyword")).distinct()
    return wanted.join(seen, ["source", "keyword"], "left_anti").select("source", "category", "keyword")


@query("""with f as (select o_custkey, l_partkey, l_orderkey, l_linenumber from lineitem join orders on o_orderkey = l_orderkey),
 p as (select * from f where l_partkey in (select l_partkey from f group by 1 having count(*) >= 30))
 select * from p where o_custkey in (select o_custkey from p group by 1 having count(*) >= 20)""")
def dense_filter(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    facts = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(orders, "l_orderkey")
    dense = select.dense_subset(facts, "l_partkey", "o_custkey", 30, 20)
    return dense.select("o_custkey", "l_partkey", "l_orderkey", "l_linenumber")


@query("""with a as (select distinct split_part(p_name, ' ', 2) as anchor from part where p_brand = 'Brand#1'
 union select distinct p_name from part where p_brand = 'Brand#2')
 select p_partkey, p_name, anchor from part, a where contains(p_name, anchor)""")
def anchor_contains(t: Tables) -> DataFrame:
    words = t.part.filter("p_brand = 'Brand#1'").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("anchor"))
    anchors = words.union(t.part.filter("p_brand = 'Brand#2'").select("p_name"))
    return lookups.contained_anchors(t.part.select("p_partkey", "p_name"), "p_name", anchors, "anchor")


_BLOCKS = """pairs as (select distinct p_name, wanted from t, w),
 spots as (select p_name, wanted, i, j from (select *, unnest(range(length(wanted))) as i from pairs) a, lateral (select unnest(range(length(p_name))) as j)
  where substr(wanted, i::int + 1, 1) = substr(p_name, j::int + 1, 1)),
 ends as (select *, i - row_number() over (partition by p_name, wanted, i - j order by i) as island from spots),
 runs as (select p_name, wanted, i, j, max(i) over (partition by p_name, wanted, i - j, island) - i + 1 as len from ends),
 parts as (select p_name, wanted, 0::bigint as alo, length(wanted)::bigint as ahi, 0::bigint as blo, length(p_name)::bigint as bhi, 0::bigint as size from pairs
  union all select p_name, wanted, x.alo, x.ahi, x.blo, x.bhi, x.size from (
   select p_name, wanted, unnest([{'alo': alo, 'ahi': b.i, 'blo': blo, 'bhi': b.j, 'size': -b.k}, {'alo': b.i - b.k, 'ahi': ahi, 'blo': b.j - b.k, 'bhi': bhi, 'size': 0::bigint}]) as x
   from (select p.p_name, p.wanted, alo, ahi, blo, bhi, min({'k': -least(len, ahi - i, bhi - j), 'i': i, 'j': j}) as b
    from parts p join runs r on r.p_name = p.p_name and r.wanted = p.wanted and i >= alo and i < ahi and j >= blo and j < bhi group by all))),
 alike as (select p_name, wanted, 2 * sum(size)::double / (length(p_name) + length(wanted)) as alike from parts group by p_name, wanted)"""


@query(f"""with recursive t as (select p_name, count(*) as score from part group by p_name), w as (select unnest([{sql_list(WANTED_TITLES)}]) as wanted),
 {_BLOCKS}, r as (select wanted, p_name, score, alike from t join alike using (p_name)),
 l as (select *, case when p_name = wanted then 1 when contains(p_name, wanted) then 2 when alike >= 0.55 then 3 end as level from r)
 select wanted, p_name, level::int as level from (select *, row_number() over (partition by wanted order by level,
 case when level = 3 then alike else score end desc, p_name) as rn from l where level is not null) where rn = 1""")
def title_lookup(t: Tables) -> DataFrame:
    """Best part title for each wanted text, over all titles."""
    titles = t.part.groupBy("p_name").agg(F.count("*").alias("score"))
    return lookups.find_titles(titles, "p_name", "score", WANTED_TITLES)


@query("""select c_custkey, lower(c_name) as label, c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT'
 and o_totalprice > 400000) as is_close from customer""")
def close_flag(t: Tables) -> DataFrame:
    close = t.orders.filter("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select(
        F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("is_close")
    ).distinct()
    flagged = t.customer.select("c_custkey", F.lower("c_name").alias("label")).join(close, "c_custkey", "left")
    return flagged.withColumn("is_close", F.coalesce("is_close", F.lit(False)))


@query("""with p as (select user_id, list(distinct event_type) as kinds, arg_max(event_type, event_id) as last_kind from events group by user_id)
 select user_id, list_contains(kinds, 'purchase') and last_kind is not null or last_kind in ('error') as matched from p""")
def facet_match(t: Tables) -> DataFrame:
    """An owner matches when a wanted kind is among its kinds or is its last kind."""
    kinds = t.events.groupBy("user_id").agg(
        F.collect_set("event_type").alias("kinds"), F.max_by("event_type", "event_id").alias("last_kind")
    )
    matched = F.arrays_overlap("kinds", F.array(F.lit("purchase"))) | F.col("last_kind").isin("error")
    return kinds.select("user_id", matched.alias("matched"))


@query(f"""with k as ({" union all ".join(f"select '{c}' as category, {i} as place, unnest([{sql_list(w)}]) as keyword" for i, (c, w) in enumerate(CATEGORIES.items()))}),
 topics as (select distinct word as topic from (select unnest(string_split_regex(lower(text), '\\s')) as word from documents) where length(word) > 2)
 select topic, first(category order by place) as category from topics, k
 where regexp_matches(topic, '(^|[^a-z])' || keyword || '($|[^a-z])') group by topic""")
def first_category(t: Tables) -> DataFrame:
    words = t.texts.select(F.explode(F.split(F.lower("text"), r"\s")).alias("topic")).filter(F.length("topic") > 2)
    return terms.first_claims(words.distinct(), "topic", CATEGORIES)


@query(_CASCADE + """, v as (select user_id, track, match_type, count(*) as n from m where match_type in ('manual', 'temporal', 'semantic') group by all),
 w as (select user_id, track, sum(n)::bigint as votes, arg_min(match_type, {'a': -n, 'b': match_type}) as kind from v group by user_id, track),
 best as (select * from (select *, row_number() over (partition by user_id order by votes desc, track) as rn from w) where rn = 1),
 owners as (select distinct user_id from events),
 loved as (select user_id, min(track) as track from plays where value >= 90 group by user_id)
 select o.user_id, coalesce(best.track, loved.track, favourite.track) as track, case when best.track is not null then kind when loved.track is not null then 'semantic'
 when favourite.track is not null then 'fallback' else 'none' end as match_type, coalesce(votes, 0)::bigint as votes
 from owners o left join best using (user_id) left join loved using (user_id) left join favourite using (user_id)""")
def scene_match(t: Tables) -> DataFrame:
    """Track of every owner: what their photos agree on, else a dear one, else their most played."""
    plays = _of_type(t, "view").select("user_id", json_value(F.col("props"), "$.k").cast("int").alias("track"), "value").filter("track is not null")
    loved = plays.filter("value >= 90").groupBy("user_id").agg(F.min("track").alias("track"))
    favourite = select.mode_per_group(plays, ["user_id"], "track", "track").select("user_id", "track")
    owners = t.events.select("user_id").distinct()
    return album.match_scenes(_matches(t), owners, ["user_id"], [("semantic", loved), ("fallback", favourite)], "track")
