"""Merges of a batch into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.operators import merge
from activity_engine.plans.registry import Tables, query


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


_NATURAL = "user_id, event_type, day"
_DAYS = "(select *, cast(ts as date)::varchar as day from events)"


@query(f"""with o as (select event_id, {_NATURAL}, value from (select *, row_number() over (partition by {_NATURAL} order by event_id) as rn
  from {_DAYS} where ts < timestamp '2024-01-16') where rn = 1),
 n as (select event_id, {_NATURAL}, value from (select *, row_number() over (partition by {_NATURAL} order by event_id) as rn
  from {_DAYS} where ts >= timestamp '2024-01-10') where rn = 1)
 select * from o union all select * from n where not exists (select 1 from o where o.user_id = n.user_id and o.event_type = n.event_type and o.day = n.day)""")
def merge_insert(t: Tables) -> DataFrame:
    """A second export that overlaps the first is merged on its natural key."""
    keys = ["user_id", "event_type", "day"]
    events = t.events.withColumn("day", F.to_date("ts").cast("string")).select("event_id", *keys, "value", "ts")
    first = merge.first_per_key(events.filter(F.col("ts") < _at("2024-01-16")).drop("ts"), keys, ["event_id"])
    second = events.filter(F.col("ts") >= _at("2024-01-10")).drop("ts")
    return merge.insert_absent(first, second, keys, ["event_id"])


@query("""with s as (select p_partkey, p_name, round(p_retailprice * 1.1, 2) as p_retailprice from part where p_size > 25
 union all select p_partkey + 1000000, p_name, p_retailprice from part where p_brand = 'Brand#1')
 select p_partkey, p_name, p_retailprice from part where p_partkey not in (select p_partkey from s) union all select * from s""")
def merge_upsert(t: Tables) -> DataFrame:
    """Changed prices replace the old rows, new parts are added."""
    target = t.part.select("p_partkey", "p_name", "p_retailprice")
    dearer = t.part.filter("p_size > 25").select("p_partkey", "p_name", F.round(F.col("p_retailprice") * 1.1, 2).alias("p_retailprice"))
    fresh = t.part.filter("p_brand = 'Brand#1'").select((F.col("p_partkey") + 1000000).alias("p_partkey"), "p_name", "p_retailprice")
    return merge.upsert(target, dearer.union(fresh), ["p_partkey"], ["p_retailprice"])


@query("""with e as (select event_id, user_id, date_trunc('hour', ts)::timestamp as hour_ts, event_type from events),
 o as (select event_id, user_id, hour_ts from (select *, row_number() over (partition by user_id, hour_ts order by event_id) as rn from e
  where event_type in ('view', 'click')) where rn = 1),
 n as (select event_id, user_id, hour_ts from (select *, row_number() over (partition by user_id, hour_ts order by event_id) as rn from e
  where event_type not in ('view', 'click')) where rn = 1)
 select * from o union all select * from n where not exists (select 1 from o where o.user_id = n.user_id and o.hour_ts = n.hour_ts)""")
def merge_expr_key(t: Tables) -> DataFrame:
    """The key is an expression: the owner and the hour."""
    keys = ["user_id", "hour_ts"]
    hourly = t.events.withColumn("hour_ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    seen = F.col("event_type").isin("view", "click")
    first = merge.first_per_key(hourly.filter(seen).select("event_id", *keys), keys, ["event_id"])
    return merge.insert_absent(first, hourly.filter(~seen).select("event_id", *keys), keys, ["event_id"])


@query("""with o as (select p_partkey, [p_type, p_brand] as tags from part where p_size > 10)
 select p.p_partkey, array_to_string(case when p.p_size > 30 then [p.p_name] when o.tags is not null then o.tags else [] end, ',') as tags
 from part p left join o using (p_partkey)""")
def tag_refresh(t: Tables) -> DataFrame:
    """A refreshed library keeps the tags it had where the new rows have none."""
    empty = F.array().cast("array<string>")
    new = t.part.select("p_partkey", F.when(F.col("p_size") > 30, F.array("p_name")).otherwise(empty).alias("tags"))
    old = t.part.filter("p_size > 10").select("p_partkey", F.array("p_type", "p_brand").alias("tags"))
    return merge.refresh_tags(new, old, "p_partkey", "tags").select("p_partkey", F.array_join("tags", ",").alias("tags"))
