"""Scenes of a photo album."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.operators import album, vectors
from activity_engine.plans.registry import Tables, query
from activity_engine.session import durable

_GAP = 1800


def _photos(t: Tables) -> DataFrame:
    """Events are photos, each with the vector numbered like it, modulo the number of vectors; owners share three
    albums. 'error' ones have no date, 'signup' ones only in their name."""
    count = t.embeddings.agg(F.count("*")).scalar()
    shots = t.events.withColumn("vec_id", F.col("event_id") % count).join(t.embeddings.select("vec_id", "embedding"), "vec_id")
    named = F.when(F.col("event_type") == "signup", F.date_format("ts", "'IMG_'yyyyMMdd'.jpg'")).otherwise(F.lit("IMG.jpg"))
    dated = F.when(~F.col("event_type").isin("error", "signup"), F.col("ts"))
    return shots.select((F.col("user_id") % 3).cast("string").alias("album"), "event_id", dated.alias("ts"), named.alias("filename"), "embedding")


_SCENES = f"""p as (select (user_id % 3)::varchar as album, event_id, case when event_type not in ('error', 'signup') then ts end as ts,
  case when event_type = 'signup' then date_trunc('day', ts)::timestamp + interval 12 hour end as written, list_transform(embedding, lambda x: x::double) as v
  from events join embeddings on vec_id = event_id % (select count(*) from embeddings)),
 g as (select *, case when ts - lag(ts) over (partition by album order by ts) > interval {_GAP} second then 1 else 0 end as starts from p where ts is not null),
 d as (select *, sum(starts) over (partition by album order by ts) as scene_id from g),
 s as (select album, scene_id, min(ts) as start_ts, epoch_us(min(ts)) + floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 2) as mid from d group by album, scene_id),
 n as (select album, event_id, scene_id, row_number() over (partition by event_id order by abs(mid - epoch_us(written)), scene_id) as rn
  from p join s using (album) where written is not null),
 c as (select album, scene_id, list(x order by pos) as v from (select album, scene_id, pos, avg(x) as x from (
  select album, scene_id, unnest(v) as x, unnest(range(len(v))) as pos from d) group by all) group by album, scene_id),
 l as (select p.album, event_id, c.scene_id, round(list_cosine_similarity(p.v, c.v), 6) as sim, row_number() over (partition by event_id
  order by round(list_cosine_similarity(p.v, c.v), 7) desc, c.scene_id) as rn from p join c on p.album = c.album where ts is null and written is null),
 a as (select album, event_id, scene_id, 'date' as placed_by from d union all select album, event_id, scene_id, 'filename' from n where rn = 1
  union all select album, event_id, scene_id, 'vector' from l where rn = 1 and sim >= 0.6
  union all select album, event_id, (select max(scene_id) + 1 from s where s.album = l.album), 'none' from l where rn = 1 and sim < 0.6)"""


@query(f"""with {_SCENES} select event_id, scene_id::bigint as scene_id, placed_by, coalesce(case when hour(start_ts) < 6 then 'Nuit' when hour(start_ts) < 12 then 'Matin'
 when hour(start_ts) < 18 then 'Après-midi' when hour(start_ts) < 23 then 'Soirée' else 'Nuit' end || ' · ' || day(start_ts) || ' '
 || (['jan', 'fév', 'mar', 'avr', 'mai', 'juin', 'juil', 'août', 'sep', 'oct', 'nov', 'déc'])[month(start_ts)] || ' ' || year(start_ts), 'Moment sans date') as scene_name
 from a left join s using (album, scene_id)""")
def scene_assign(t: Tables) -> DataFrame:
    placed = album.assign_scenes(_photos(t), "album", "event_id", "ts", "filename", "embedding", _GAP)
    return placed.select("event_id", "scene_id", "placed_by", "scene_name")


@query(f"""with {_SCENES}, q as (select a.album, a.scene_id, event_id, p.v, p.ts from a join p using (event_id)),
 m as (select album, scene_id, list(x order by pos) as mean from (select album, scene_id, pos, avg(x) as x from (
  select album, scene_id, unnest(v) as x, unnest(range(len(v))) as pos from q) group by all) group by album, scene_id),
 f as (select album, scene_id, event_id, row_number() over (partition by album, scene_id order by round(sqrt(list_sum(list_transform(list_zip(v, mean), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9), event_id) as rn
  from q join m using (album, scene_id))
 select q.album, q.scene_id::bigint as scene_id, count(*) as photo_count, min(q.ts) as first_ts, max(q.ts) as last_ts, any_value(f.event_id) as representative
 from q join f on f.album = q.album and f.scene_id = q.scene_id and rn = 1 group by q.album, q.scene_id""")
def scene_centroids(t: Tables) -> DataFrame:
    photos = _photos(t)
    scenes = album.assign_scenes(photos, "album", "event_id", "ts", "filename", "embedding", _GAP).select("event_id", F.struct("album", "scene_id").alias("scene"))
    placed = durable(photos.join(scenes, "event_id"))  # read for the means and again for the distances
    means = vectors.centroids(placed, "scene", "embedding", F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    best = vectors.representatives(placed, "scene", "event_id", "embedding", means)
    return means.join(best, "scene").select(
        "scene.album", "scene.scene_id", F.col("n_members").alias("photo_count"), "first_ts", "last_ts", F.col("event_id").alias("representative")
    )
