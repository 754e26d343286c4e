"""Photo scenes, scene centroids and the music that goes with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.functions import calendar as cal
from activity_engine.operators import nearest, timejoins, vectors
from activity_engine.operators.select import first_per_key, mode_per_group
from activity_engine.operators.sessions import sessions, with_session
from activity_engine.session import durable

UNDATED = "Moment sans date"


def assign_scenes(
    photos: DataFrame, album: str, photo_id: str, ts: str, filename: str, vector: str,
    gap_seconds: float = 6 * 3600.0, threshold: float = 0.60,
) -> DataFrame:
    """Photos with their scene.

    Dated photos are grouped by silences; a photo without a date goes to the scene whose middle is closest to the
    date in its file name, else to the scene with the most similar mean vector, else to one further scene per album.
    """
    photos = photos.select(album, photo_id, ts, filename, vector)
    dated = durable(with_session(photos, album, ts, gap_seconds).withColumnRenamed("session_no", "scene_id"))
    scenes = durable(sessions(photos, album, ts, gap_seconds).withColumnRenamed("session_no", "scene_id"))
    undated = photos.filter(F.col(ts).isNull()).withColumn("_written", cal.filename_date(F.col(filename)))

    written = undated.filter(F.col("_written").isNotNull()).select(album, photo_id, F.col("_written").alias("_at"))
    middles = scenes.select(album, "scene_id", F.col("mid_ts").alias("_at"))
    by_name = timejoins.nearest_in_time(written, middles, [album], photo_id, "scene_id", "_at").select(
        album, photo_id, "scene_id", F.lit("filename").alias("placed_by")
    )

    keyed = dated.withColumn("_scene", F.struct(album, "scene_id"))
    means = vectors.centroids(keyed, "_scene", vector).select(F.col(f"_scene.{album}").alias(album), F.col("_scene.scene_id").alias("scene_id"), "centroid")
    rest = durable(undated.filter(F.col("_written").isNull()).select(album, photo_id, vector))
    best = F.get("matches", F.lit(0))
    alike = nearest.best_within(rest, means, album, vector, "scene_id", "centroid").filter(-best["loss"] >= threshold)
    by_look = durable(alike.select(album, photo_id, best["ref"].alias("scene_id"), F.lit("vector").alias("placed_by")))

    after_last = scenes.groupBy(album).agg((F.max("scene_id") + 1).alias("_next"))
    left = rest.select(album, photo_id).join(by_look.select(album, photo_id), [album, photo_id], "left_anti")
    nowhere = left.join(after_last, album, "left").select(
        album, photo_id, F.coalesce("_next", F.lit(0)).alias("scene_id"), F.lit("none").alias("placed_by")
    )
    first = dated.select(album, photo_id, "scene_id", F.lit("date").alias("placed_by"))
    placed = first.unionByName(by_name).unionByName(by_look).unionByName(nowhere)
    names = scenes.select(album, "scene_id", cal.scene_label(F.col("start_ts")).alias("scene_name"))
    return placed.join(names, [album, "scene_id"], "left").withColumn("scene_name", F.coalesce("scene_name", F.lit(UNDATED)))


def match_music(
    photos: DataFrame, plays: DataFrame, overrides: DataFrame, by_text: DataFrame, by_context: DataFrame,
    owner: str, photo_id: str, ts: str, track: str, window_seconds: float = 3600.0, wide_seconds: float = 3 * 3600.0,
) -> DataFrame:
    """Track of each photo: override, most played nearby, text match, context match, most played in a wider window, the owner's
    most played overall. Each costly level is run only for the photos still without a track.

    A photo is known by ``owner`` and ``photo_id``, in all inputs; every owner is matched by their own plays alone.
    """
    both = [owner, photo_id]
    shots = durable(photos.select(owner, photo_id, ts).withColumn("_shot", F.monotonically_increasing_id()))
    known = durable(plays.select(owner, ts, track))
    ids = shots.select(*both, "_shot")

    def level(df: DataFrame) -> DataFrame:
        return durable(ids.join(df.select(*both, track, "match_score"), both).select("_shot", track, "match_score"))

    def rest(levels: list[DataFrame]) -> DataFrame:
        left = shots
        for found in levels:
            left = left.join(found.select("_shot"), "_shot", "left_anti")
        return left

    manual = level(first_per_key(overrides.select(*both, track), both, [track]).withColumn("match_score", F.lit(1.0)))
    scored = F.col("n").cast("double").alias("match_score")
    near = timejoins.modal_item_nearby(rest([manual]), known, owner, "_shot", ts, track, window_seconds)
    near = durable(near.select("_shot", track, scored))
    texts = [level(by_text), level(by_context)]
    wide = timejoins.modal_item_nearby(rest([manual, near, *texts]), known, owner, "_shot", ts, track, wide_seconds)
    wide = wide.select("_shot", track, scored)
    favourites = mode_per_group(known.filter(F.col(track).isNotNull()), [owner], track, track)
    anything = ids.join(favourites.select(owner, track), owner).select("_shot", track, F.lit(0.0).alias("match_score"))
    levels = [
        ("manual", manual), ("temporal", near), ("semantic", texts[0]), ("semantic", texts[1]), ("temporal", wide),
        ("fallback", anything),
    ]
    return timejoins.cascade(shots, "_shot", levels, [track, "match_score"]).drop("_shot")


def match_scenes(matches: DataFrame, scenes: DataFrame, scene: list[str], levels: list[tuple[str, DataFrame]], track: str) -> DataFrame:
    """(scene, track, match_type, votes) of every scene: the track that most of its strongly matched photos agree on, else the
    first of ``levels`` (scene, track) that knows the scene, else none."""
    strong = matches.filter(F.col("match_type").isin(*STRONG) & F.col(track).isNotNull())
    kinds = strong.groupBy(*scene, track, "match_type").agg(F.count("*").alias("_n")).groupBy(*scene, track).agg(
        F.min_by("match_type", F.struct(-F.col("_n"), F.col("match_type"))).alias("_kind"))
    voted = scene_votes(matches, scene, track).join(kinds, [*scene, track])
    numbered = durable(scenes.select(*scene).distinct().withColumn("_scene", F.monotonically_increasing_id()))
    ids = lambda df: numbered.join(df, scene)
    strong = ids(voted).select("_scene", track, "votes", "_kind")
    others = [(name, ids(df.select(*scene, track)).select("_scene", track, F.lit(0).cast("long").alias("votes"), F.lit(name).alias("_kind")))
              for name, df in levels]
    found = timejoins.cascade(numbered, "_scene", [("strong", strong), *others], [track, "votes", "_kind"])
    return found.drop("match_type").select(*scene, track, F.coalesce("_kind", F.lit("none")).alias("match_type"), F.coalesce("votes", F.lit(0)).alias("votes"))


STRONG = ("manual", "temporal", "semantic")


def scene_votes(matches: DataFrame, scene: list[str], track: str, strong: tuple[str, ...] = STRONG) -> DataFrame:
    """Track most photos of a scene agree on, counting strong matches only."""
    return mode_per_group(matches.filter(F.col("match_type").isin(*strong)), scene, track, track, "votes")


def scene_playlist(scenes: DataFrame, plays: DataFrame, owner: str, scene: str, ts: str, play_id: str, window_seconds: float = 3600.0) -> DataFrame:
    """Plays around each scene in order of time, ranked from 0."""
    from activity_engine.operators.ordered import dense_position

    heard = timejoins.span_join(scenes.select(owner, scene, "start_ts", "end_ts"), plays, owner, "start_ts", "end_ts", ts, window_seconds)
    return dense_position(heard.drop("start_ts", "end_ts"), [owner, scene], [ts, play_id], "rank")
