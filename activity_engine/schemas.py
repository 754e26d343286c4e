"""Activity tables: raw schema, merge key and quality rules in one place, for writers and checks alike."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from activity_engine.operators import quality as q


@dataclass(frozen=True)
class Table:
    """``rules`` are the row rules, ``unique`` the key that may not repeat (with a tolerance), ``partition`` the month
    column of tables whose key holds the instant."""

    name: str
    columns: Sequence[str]
    key: Sequence[str]
    rules: Sequence[q.Rule] = ()
    unique: Sequence[str] = ()
    tolerance: int = 0
    min_rows: int = 1
    partition: str | None = None


def tables() -> dict[str, Table]:
    """All activity tables by name (built on call: a rule holds a column, which needs a running session)."""
    stamped = [q.not_null("timestamp_ms"), q.positive("timestamp_ms")]
    seconds = [q.not_null("timestamp"), q.positive("timestamp")]
    listed = [
        Table("spotify_streams", ["artistName", "trackName", "msPlayed", "minutes_played", "trackUri", "skipped", "shuffle",
                                  "listen_ts", "listen_year", "listen_month", "listen_hour", "listen_weekday",
                                  "listen_week", "is_night"],
              ["artistName", "trackName", "listen_minute"],
              [q.not_null("trackName"), q.not_null("artistName"), q.not_null("listen_ts"), q.at_least("msPlayed", 30_000)],
              ["trackName", "artistName", "listen_ts"], min_rows=1001),
        Table("spotify_liked_songs", ["artistName", "albumName", "trackName", "trackUri"], ["trackUri"],
              [q.not_null("trackUri"), q.not_null("trackName")], ["trackUri"]),
        Table("spotify_playlists", ["playlistName", "lastModifiedDate", "trackName", "artistName", "albumName", "trackUri",
                                    "addedDate"],
              ["playlistName", "trackUri", "addedDate"], [q.not_null("playlistName"), q.not_null("trackUri")]),
        Table("spotify_searches", ["search_ts", "query", "platform", "event_hour", "event_weekday"], ["query", "search_ts"],
              [q.not_null("query"), q.not_null("search_ts")]),
        Table("instagram_comments", ["text", "media_owner", "timestamp"], ["text", "timestamp"], [q.not_null("text"), *seconds]),
        Table("instagram_likes", ["post_url", "timestamp"], ["post_url", "timestamp"], [q.not_null("post_url"), *seconds]),
        Table("instagram_saved", ["account", "post_href", "timestamp"], ["post_href", "timestamp"],
              [q.not_null("post_href"), *seconds]),
        Table("instagram_posts_viewed", ["author", "timestamp"], ["author", "timestamp"], seconds),
        Table("instagram_videos_watched", ["author", "timestamp"], ["author", "timestamp"], seconds),
        Table("instagram_story_likes", ["author", "timestamp"], ["author", "timestamp"], seconds),
        Table("instagram_searches", ["query", "timestamp"], ["query", "timestamp"], [q.not_null("query"), *seconds]),
        Table("instagram_messages_meta", ["conv_id", "is_group", "participants", "sender_anon", "timestamp_ms", "msg_type",
                                          "char_count"],
              ["conv_id", "sender_anon", "timestamp_ms", "msg_type"],
              [q.not_null("conv_id"), q.not_null("sender_anon"), q.not_null("msg_type"), *stamped]),
        Table("tiktok_watch", ["video_id", "url", "timestamp_ms"], ["video_id", "timestamp_ms"], [q.not_null("video_id"), *stamped]),
        Table("tiktok_likes", ["video_id", "url", "timestamp_ms"], ["video_id", "timestamp_ms"], [q.not_null("video_id"), *stamped]),
        Table("tiktok_saves", ["video_id", "url", "timestamp_ms"], ["video_id", "timestamp_ms"], [q.not_null("video_id"), *stamped]),
        Table("tiktok_searches", ["query", "timestamp_ms"], ["query", "timestamp_ms"], stamped),
        Table("tiktok_comments", ["text", "url", "timestamp_ms"], ["text", "timestamp_ms"], [q.not_null("text"), *stamped]),
        Table("tiktok_messages_meta", ["conv_id", "sender_anon", "is_me", "timestamp_ms", "msg_type", "char_count"],
              ["conv_id", "sender_anon", "timestamp_ms"],
              [q.not_null("conv_id"), q.not_null("sender_anon"), q.not_null("msg_type"), *stamped]),
        Table("tiktok_messages_text", ["text", "timestamp_ms"], ["text", "timestamp_ms"], stamped),
        Table("tiktok_favorite_hashtags", ["hashtag"], ["hashtag"], [q.not_null("hashtag")]),
        Table("tiktok_ads_interests", ["category"], ["category"], [q.not_null("category")]),
        Table("twitter_tweets", ["tweet_id", "text", "raw_text", "lang", "timestamp_ms"], ["tweet_id"],
              [q.not_null("tweet_id")], ["tweet_id"]),
        Table("twitter_likes", ["tweet_id", "full_text", "post_url"], ["tweet_id"], [q.not_null("tweet_id")], ["tweet_id"]),
        Table("twitter_saved_searches", ["query"], ["query"], [q.not_null("query")]),
        Table("google_searches", ["query", "title", "url", "timestamp_ms"], ["query", "timestamp_ms"], [q.not_null("query"), *stamped]),
        Table("google_chrome", ["domain", "title", "url", "timestamp_ms"], ["url", "timestamp_ms"], stamped),
        Table("youtube_watch", ["video_id", "title", "url", "author", "timestamp_ms"], ["video_id", "timestamp_ms"],
              [q.not_null("video_id"), *stamped]),
        Table("youtube_searches", ["title", "url", "timestamp_ms"], ["title", "timestamp_ms"], stamped),
        Table("netflix_views", ["raw_title", "show_title", "season", "episode_title", "content_type", "watch_date"],
              ["raw_title", "watch_date"],
              [q.not_null("show_title"), q.not_null("watch_date"), q.one_of("content_type", ["series", "movie"])],
              ["raw_title", "watch_date"], 10, 101),
        Table("scenes", ["album", "photo_id", "scene_id", "path"], ["album", "photo_id"],
              [q.not_null("photo_id"), q.not_null("scene_id"), q.not_null("path")]),
        Table("scene_centroids", ["album", "scene_id", "scene_name", "photo_count"], ["album", "scene_id"],
              [q.not_null("scene_id"), q.not_null("scene_name"), q.positive("photo_count")], ["album", "scene_id"]),
        Table("music_matches", ["album", "scene_id", "track", "match_type", "votes"], ["album", "scene_id"],
              [q.not_null("scene_id"), q.one_of("match_type", ["temporal", "semantic", "manual", "fallback", "none"])],
              ["album", "scene_id"]),
        Table("photo_music", ["album", "photo_id", "track", "match_type", "match_score"], ["album", "photo_id"],
              [q.not_null("photo_id"), q.one_of("match_type", ["temporal", "semantic", "manual", "fallback", "none"])], ["album", "photo_id"]),
        Table("group_playlists", ["album", "scene_id", "play_id", "rank"], ["album", "scene_id", "rank"],
              [q.not_null("scene_id"), q.not_null("play_id")], ["album", "scene_id", "rank"]),
    ]
    instants = {"timestamp": "event_month", "timestamp_ms": "event_month", "listen_minute": "listen_month", "watch_date": "watch_month"}

    def month(table: Table) -> str | None:
        return next((instants[k] for k in table.key if k in instants), None)

    return {t.name: replace(t, partition=month(t)) for t in listed}
