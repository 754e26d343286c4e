"""The jobs a person runs: exports into activity tables, and profiles, albums, a corpus and contacts from them.

Every function reads from and writes to a ``Warehouse`` and returns the rows written per table. A missing export or
table is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_engine import schemas
from activity_engine.functions import titles
from activity_engine.operators import album, corpus, density, graph, hierarchy, profiles, projection, quality, report, terms, vectors
from activity_engine.operators.select import mode_per_group, top_per_group
from activity_engine.session import durable
from activity_engine.sources import activity_html, clips, films, music, posts, social
from activity_engine.warehouse import Warehouse


#: Whose exports they are, where nobody is named.
OWNER = "owner"


def _store(house: Warehouse, tables: dict[str, DataFrame], owner: str) -> dict[str, int]:
    """Equal rows of two owners are two rows: the owner is a column and part of every key."""
    known = schemas.tables()
    return {
        name: house.insert_absent(name, df.withColumn("owner", F.lit(owner)), ["owner", *known[name].key], partition=known[name].partition)
        for name, df in tables.items()
    }


def _found(house: Warehouse, folder: str, *patterns: str) -> list[str]:
    return social.existing(house.spark, [f"{folder}/{p}" for p in patterns])


def _each(house: Warehouse, folder: str, wanted: dict[str, tuple[Sequence[str], Callable]]) -> dict[str, DataFrame]:
    """Tables whose files exist, read by their reader."""
    files = {name: (_found(house, folder, *patterns), reader) for name, (patterns, reader) in wanted.items()}
    return {name: reader(house.spark, paths) for name, (paths, reader) in files.items() if paths}


def ingest_films(house: Warehouse, folder: str, owner: str = OWNER) -> dict[str, int]:
    return _store(house, _each(house, folder, {"netflix_views": (["NetflixViewingHistory.csv"], films.views)}), owner)


def ingest_music(house: Warehouse, folder: str, owner: str = OWNER) -> dict[str, int]:
    long = _found(house, folder, "extended/Streaming_History_Audio_*.json")
    short = _found(house, folder, "account/StreamingHistory_music_*.json")
    read = _each(house, folder, {
        "spotify_liked_songs": (["account/YourLibrary.json"], music.library),
        "spotify_playlists": (["account/Playlist*.json"], music.playlists),
        "spotify_searches": (["account/SearchQueries.json"], music.searches),
    })
    if long or short:  # either history alone is a history
        read["spotify_streams"] = music.play_history(house.spark, long, short)
    return _store(house, read, owner)


def ingest_social(house: Warehouse, folder: str, salt: str, owner: str = OWNER) -> dict[str, int]:
    def seen(kind: str) -> Callable:
        return lambda spark, paths: social.activity_list(spark, paths, kind)

    return _store(house, _each(house, folder, {
        "instagram_comments": (["comments/post_comments_*.json"], social.comments),
        "instagram_likes": (["likes/liked_posts.json"], social.likes),
        "instagram_saved": (["saved/saved_posts.json"], social.saved),
        "instagram_posts_viewed": (["ads_and_topics/posts_viewed.json", "impressions/posts_viewed.json"], seen("posts_viewed")),
        "instagram_videos_watched": (["ads_and_topics/videos_watched.json", "impressions/videos_watched.json"], seen("videos_watched")),
        "instagram_story_likes": (
            [f"{p}story_likes.json" for p in ("story_activities/", "story_interactions/", "likes/", "")], seen("story_likes")),
        "instagram_searches": (["searches/word_or_phrase_searches.json", "word_or_phrase_searches.json"], social.searches),
        "instagram_messages_meta": (
            ["messages/inbox/*/message_*.json"], lambda spark, paths: social.message_meta(social.messages(spark, paths), salt)),
    }), owner)


def ingest_clips(house: Warehouse, path: str, me: str, salt: str, owner: str = OWNER) -> dict[str, int]:
    export = durable(clips.read(house.spark, path))  # one document, read once for all its lists
    messages = clips.messages(export, me)
    return _store(house, {
        "tiktok_watch": clips.actions(export, "watch"), "tiktok_likes": clips.actions(export, "like"),
        "tiktok_saves": clips.actions(export, "save"), "tiktok_searches": clips.searches(export),
        "tiktok_comments": clips.comments(export), "tiktok_messages_meta": clips.message_meta(messages, salt),
        "tiktok_messages_text": clips.own_text(messages), "tiktok_favorite_hashtags": clips.hashtags(export),
        "tiktok_ads_interests": clips.ad_interests(export),
    }, owner)


def ingest_posts(house: Warehouse, folder: str, owner: str = OWNER) -> dict[str, int]:
    return _store(house, _each(house, folder, {
        "twitter_tweets": (["data/tweets.js"], posts.tweets), "twitter_likes": (["data/like.js"], posts.likes),
        "twitter_saved_searches": (["data/saved-search.js"], posts.saved_searches),
    }), owner)


def ingest_activity_pages(house: Warehouse, searches: str | None = None, visits: str | None = None,
                          watched: str | None = None, video_searches: str | None = None, owner: str = OWNER) -> dict[str, int]:
    wanted = {
        "google_searches": (searches, "google_search", activity_html.searches),
        "google_chrome": (visits, "chrome_visit", activity_html.visits),
        "youtube_watch": (watched, "youtube_watch", activity_html.watched_videos),
        "youtube_searches": (video_searches, "youtube_search", activity_html.video_searches),
    }
    return _store(house, {
        name: derive(activity_html.activity(house.spark, path, kind)) for name, (path, kind, derive) in wanted.items() if path
    }, owner)


# Table, platform name, column of the instant.
PROFILE_SOURCES = (
    ("youtube_watch", "youtube", "event_date"),
    ("google_searches", "google", "event_date"),
    ("google_chrome", "chrome", "event_date"),
    ("spotify_streams", "spotify", "listen_ts"),
    ("netflix_views", "netflix", "watch_date"),
    ("tiktok_watch", "tiktok", "event_date"),
    ("tiktok_likes", "tiktok_likes", "event_date"),
    ("tiktok_searches", "tiktok_search", "event_date"),
    ("instagram_likes", "instagram", "event_date"),
    ("instagram_saved", "instagram_saved", "event_date"),
    ("instagram_comments", "instagram_comment", "event_date"),
    ("instagram_posts_viewed", "ig_posts", "event_date"),
    ("instagram_videos_watched", "ig_videos", "event_date"),
    ("instagram_story_likes", "ig_stories", "event_date"),
    ("instagram_searches", "ig_search", "event_date"),
    ("twitter_tweets", "twitter", "event_date"),
)
FILM_HOUR = 21  # films are dated by day

# Platform, and the table and column its keywords are read from.
KEYWORD_SOURCES = {
    "youtube": ("youtube_watch", "title"),
    "google": ("google_searches", "query"),
    "chrome": ("google_chrome", "title"),
    "spotify": ("spotify_streams", "artistName"),
    "netflix": ("netflix_views", "show_title"),
    "tiktok": ("tiktok_searches", "query"),
    "tiktok_likes": ("tiktok_searches", "query"),
    "tiktok_search": ("tiktok_searches", "query"),
    "instagram": ("instagram_searches", "query"),
    "instagram_saved": ("instagram_searches", "query"),
    "ig_search": ("instagram_searches", "query"),
    "ig_posts": ("instagram_searches", "query"),
    "ig_videos": ("instagram_searches", "query"),
    "ig_stories": ("instagram_searches", "query"),
    "instagram_comment": ("instagram_searches", "query"),
    "twitter": ("twitter_tweets", "text"),
}


def unified_events(house: Warehouse, owner: str | None = None) -> DataFrame | None:
    """(owner, platform, ts) of every row with an instant of all activity tables there are, of one owner if named."""
    parts = []
    for table, platform, ts in PROFILE_SOURCES:
        df = house.read(table)
        if df is None:
            continue
        instant = F.col(ts).cast("timestamp")
        if table == "netflix_views":
            instant = instant + F.make_dt_interval(hours=F.lit(FILM_HOUR))
        rows = df.select("owner", F.lit(platform).alias("platform"), instant.alias("ts"))
        rows = rows if owner is None else rows.filter(F.col("owner") == owner)
        parts.append(rows.filter(F.col("ts").isNotNull()))
    return reduce(DataFrame.unionByName, parts) if parts else None


def profile_behaviour(house: Warehouse, k: int = 4, owner: str | None = None) -> dict[str, int]:
    """Behaviour clusters of the platforms, over all owners or for one."""
    events = unified_events(house, owner)
    if events is None:
        return {}
    made = durable(profiles.platform_profile(events, ["platform"], "ts"))
    clustered = profiles.behaviour_clusters(made, k)
    described = profiles.describe_clusters(clustered, "cluster", "platform").withColumnsRenamed(
        {"cluster": "cluster_id", "platforms": "top_platforms"}
    )
    labelled = described.withColumn("label", F.concat(F.lit("Profil "), "cluster_id")).drop("weekend_pct")
    return {"behavioral_clusters": house.upsert("behavioral_clusters", labelled, ["cluster_id"], ["item_count"])}


def profile_interests(house: Warehouse, stop_words: Sequence[str] | None = None, n_samples: int = 20) -> dict[str, int]:
    """Keywords and sample texts of the behaviour clusters."""
    clusters = house.read("behavioral_clusters")
    sources = {s for s in KEYWORD_SOURCES.values() if house.exists(s[0])}
    if clusters is None or not sources:
        return {}
    texts = reduce(DataFrame.unionByName, [
        house.read(table).select(F.lit(table).alias("source"), F.col(column).alias("text")) for table, column in sorted(sources)
    ])
    table_of = F.create_map(*[F.lit(x) for p, (t, _) in KEYWORD_SOURCES.items() for x in (p, t)])
    # A platform belongs to one cluster, so there are no more pairs than platforms.
    pairs = clusters.select("cluster_id", F.explode("top_platforms").alias("p")).select(
        "cluster_id", F.try_element_at(table_of, F.col("p")).alias("source")).distinct()
    mine = durable(texts.join(F.broadcast(pairs), "source"))
    words = terms.keyword_profiles(mine, "cluster_id", "source", "text", stop_words or terms.default_stop_words(house.spark))
    best = terms.top_texts(mine, ["cluster_id"], "text", n_samples)
    samples = best.groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("sample_items"))
    made = clusters.join(words, "cluster_id", "left").join(samples, "cluster_id", "left")
    return {"interest_profiles": house.upsert("interest_profiles", made, ["cluster_id"], ["item_count"])}


def build_album(house: Warehouse, photos: DataFrame, gap_hours: float = 6.0, threshold: float = 0.60) -> dict[str, int]:
    """Scenes and their centroids from photos (album, photo_id, path, filename, exif_date, embedding)."""
    held = durable(photos)
    placed = album.assign_scenes(held, "album", "photo_id", "exif_date", "filename", "embedding", gap_hours * 3600, threshold)
    scenes = durable(held.join(placed, ["album", "photo_id"]))
    keyed = scenes.withColumn("_scene", F.struct("album", "scene_id"))
    means = vectors.centroids(keyed, "_scene", "embedding", F.min("exif_date").alias("timestamp_start"),
                              F.max("exif_date").alias("timestamp_end"), F.min("scene_name").alias("scene_name"))
    best = vectors.representatives(keyed, "_scene", "photo_id", "embedding", means).withColumnRenamed("photo_id", "representative")
    made = means.join(best.drop("distance"), "_scene").select(
        "_scene.album", "_scene.scene_id", "scene_name", F.col("n_members").alias("photo_count"),
        F.col("centroid").alias("centroid_embedding"), F.col("representative").alias("representative_photo"),
        "timestamp_start", "timestamp_end")
    return {
        "scenes": house.replace_groups("scenes", scenes.drop("embedding"), ["album"]),
        "scene_centroids": house.replace_groups("scene_centroids", made, ["album"]),
    }


def cluster_photos(house: Warehouse, photos: DataFrame, min_samples: int = hierarchy.MIN_SAMPLES, min_size: int = hierarchy.MIN_SIZE,
                   names: dict[int, str] | None = None, dimensions: int = 50) -> dict[str, int]:
    """Density clusters of photo vectors over their principal axes, with their place on the first two."""
    axes = projection.principal_axes(photos, "embedding", dimensions)
    flat = durable(axes.project(photos.select("photo_id", "embedding"), "embedding").where(F.size("projected") > 0).drop("embedding"))
    found = hierarchy.density_hierarchy(flat, "photo_id", "projected", min_samples, min_size)
    label = density.cluster_name(F.col("cluster"), names or {}, F.concat(F.lit("Cluster "), "cluster"))
    place = [F.get("projected", F.lit(i)).alias(c) for i, c in enumerate("xy")]
    made = found.withColumn("cluster_label", label).join(flat.select("photo_id", *place), "photo_id")
    return {"photo_clusters": house.overwrite("photo_clusters", made)}


def build_corpus(house: Warehouse, messages: DataFrame, me: str, style: corpus.Style | None = None,
                 sizes: Sequence[int] = corpus.CONTEXT_SIZES) -> dict[str, int]:
    """Training examples from messages (conversation, timestamp_ms, sender, text), best ones per conversation."""
    style = style or corpus.Style()
    unique = messages.dropDuplicates(["conversation", "timestamp_ms", "sender", "text"])
    dated = unique.withColumn("_at", F.struct("timestamp_ms", F.xxhash64("sender", "text").alias("tie")))
    blocks = durable(corpus.turn_blocks(dated, "conversation", "_at", "sender", "text"))
    best = corpus.best_per_person(corpus.window_scores(blocks, "conversation", me, style, sizes), "conversation")
    made = corpus.messages_of(corpus.with_history(best, blocks, "conversation"), me)
    return {"examples": house.overwrite("examples", made)}


def export_corpus(house: Warehouse, me: str, other: str, style: corpus.Style | None = None, n: int = corpus.TOP_EXAMPLES) -> None:
    """Best examples as JSON lines and as readable text."""
    score = corpus.example_score(F.col("messages"), style or corpus.Style()).alias("score")
    keys = ["conversation", "block_no", "size"]
    best = house.read("examples").select(*keys, "messages", score).orderBy(F.desc("score"), *keys).limit(n)
    house.export_text(best.select(corpus.chat_json(F.col("messages"))), "corpus_json")
    numbered = top_per_group(best.withColumn("_all", F.lit(0)), ["_all"], [F.desc("score"), *map(F.col, keys)], n)
    house.export_text(numbered.select(corpus.corpus_text(F.col("messages"), F.col("rank"), me, other)), "corpus_text")


def build_contacts(house: Warehouse, messages: DataFrame, close: DataFrame, minimum: int = 5, multiplier: float = 2.0) -> dict[str, int]:
    """Contacts of the one-to-one conversations (conversation, participants); ``close`` lists labels or ids."""
    label: Column = titles.label_from_id(F.col("conversation"))
    direct = messages.filter(F.col("participants") == 2)
    named = direct.select(F.lower("conversation").alias("node_id"), label.alias("label"))
    listed = close.select(F.lower("contact").alias("contact")).distinct()
    pairs = named.distinct()
    near = pairs.join(listed, pairs["label"] == listed["contact"], "left_semi").unionByName(
        pairs.join(listed, pairs["node_id"] == listed["contact"], "left_semi")).select("node_id").distinct()
    made = graph.contact_strength(named, "node_id", near, minimum, multiplier).join(pairs, "node_id")
    return {"social_graph": house.overwrite("social_graph", made)}


def match_album(house: Warehouse, plays: DataFrame, overrides: DataFrame, by_text: DataFrame, by_context: DataFrame,
                window_seconds: float = 3600.0, wide_seconds: float = 3 * 3600.0) -> dict[str, int]:
    """Music of the photos and scenes of all albums, and the plays around each scene.

    plays (album, ts, track, play_id): whose plays go with which album; overrides (album, photo_id, track); by_text and by_context
    (album, photo_id, track, match_score). A scene without a strong match takes the likeliest text or context match of its
    photos, then the most played of its album.
    """
    photos = house.read("scenes").select("album", "photo_id", "scene_id", F.col("exif_date").alias("ts"))
    matched = durable(album.match_music(photos, plays, overrides, by_text, by_context, "album", "photo_id", "ts", "track", window_seconds, wide_seconds))
    placed = durable(matched.join(photos.select("album", "photo_id", "scene_id"), ["album", "photo_id"]))
    scene = ["album", "scene_id"]

    def likeliest(found: DataFrame) -> DataFrame:
        best = F.min_by("track", F.struct(-F.col("match_score"), F.col("track"))).alias("track")
        return photos.join(found, ["album", "photo_id"]).groupBy(*scene).agg(best)

    favourites = mode_per_group(plays.filter("track is not null"), ["album"], "track", "track").select("album", "track")
    scenes = house.read("scene_centroids").select(*scene, F.col("timestamp_start").alias("start_ts"), F.col("timestamp_end").alias("end_ts"))
    levels = [("semantic", likeliest(by_text)), ("semantic", likeliest(by_context)), ("fallback", scenes.join(favourites, "album").select(*scene, "track"))]
    heard = album.scene_playlist(scenes.withColumn("scene", F.struct(*scene)).filter("start_ts is not null"), plays, "album", "scene", "ts", "play_id", window_seconds)
    return {
        "photo_music": house.replace_groups("photo_music", placed, ["album"]),
        "music_matches": house.replace_groups("music_matches", album.match_scenes(placed, scenes, scene, levels, "track"), ["album"]),
        "group_playlists": house.replace_groups("group_playlists", heard.select("scene.album", "scene.scene_id", "play_id", "track", "ts", "rank"), ["album"]),
    }


def build_report(house: Warehouse, sections: dict[str, Callable[[], DataFrame]], wanted: Sequence[str] | None = None) -> dict[str, int]:
    """The wanted report sections (all, if none are named) as one table."""
    return {"report": house.overwrite("report", report.build(sections, list(wanted or sections)))}


#: Tables whose instants must not lie ahead, and the days they must span at least.
TIMED = {"spotify_streams": ("listen_ts", 365), "netflix_views": ("watch_date", 365), "tiktok_watch": ("event_date", 1),
         "youtube_watch": ("event_date", 1), "google_searches": ("event_date", 1), "instagram_likes": ("event_date", 1)}
#: Table, its column, and the table and column that must hold each of its values.
REFERENCES = (
    ("music_matches", "scene_id", "scene_centroids", "scene_id"), ("group_playlists", "scene_id", "scene_centroids", "scene_id"),
    ("interest_profiles", "cluster_id", "behavioral_clusters", "cluster_id"))


def check_warehouse(house: Warehouse, today: Column | None = None) -> DataFrame:
    """(table, check, detail, passed) for the required columns, the row rules, the keys, the instants and the references of every
    table present."""
    parts = []
    for name, (ts, days) in TIMED.items():
        df = house.read(name)
        if df is not None and ts in df.columns:
            timed = quality.check_time(df, name, ts, today if today is not None else F.current_timestamp(), days)
            parts.append(timed.select("table_name", F.lit("time").alias("check"), F.concat("days", F.lit(" days")).alias("detail"), (F.col("in_past") & F.col("long_enough")).alias("passed")))
    for name, key, parent, parent_key in REFERENCES:
        child, known = house.read(name), house.read(parent)
        if child is not None and known is not None:
            lost = quality.check_orphans(child.filter(F.col(key).isNotNull()), known, key, parent_key, name)
            parts.append(lost.select("table_name", F.concat(F.lit("orphans "), "key").alias("check"), F.col("orphans").cast("string").alias("detail"), (F.col("orphans") == 0).alias("passed")))
    for name, table in schemas.tables().items():
        df = house.read(name)
        if df is None:
            continue
        held = quality.check_required(df, name, table.columns, table.min_rows)
        parts.append(held.select("table_name", F.lit("required").alias("check"), "detail", (F.col("status") == "OK").alias("passed")))
        if table.rules and set(table.columns) <= set(df.columns):
            ruled = quality.check_rules(df, name, table.rules)
            parts.append(ruled.select(
                "table_name", F.concat_ws(" ", "column", "rule").alias("check"), F.col("violations").cast("string").alias("detail"), "passed"))
        if table.unique:
            own = ["owner"] if "owner" in df.columns else []
            keyed = quality.check_unique(df, name, [*own, *table.unique], table.tolerance)
            parts.append(keyed.select("table_name", F.lit("unique").alias("check"), F.col("duplicates").cast("string").alias("detail"), "passed"))
    return reduce(DataFrame.unionByName, parts)
