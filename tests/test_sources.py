"""Export files written as small literals, read by the sources."""

import datetime as dt
import importlib.util
import json

import pytest
from pyspark.sql import functions as F

from activity_engine.sources import activity_html, clips, films, images, manifest, music, posts, social, tags


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False), encoding="utf-8")
    return str(path)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*columns).collect()]


def test_film_history(spark, tmp_path):
    path = write(tmp_path / "views.csv", "Title,Date\n\"Show: Saison 2: Ep\",3/9/24\nFilm,12/31/23\nA: B: Saison x,13/45/23\n")
    got = {r["raw_title"]: r for r in films.views(spark, path).collect()}
    series = got["Show: Saison 2: Ep"]
    assert (series["content_type"], series["show_title"], series["season"], series["episode_title"]) == ("series", "Show", 2, "Ep")
    assert series["watch_date"] == dt.date(2024, 3, 9) and series["watch_month"] == "2024-03" and series["watch_weekday"] == 7
    assert (got["Film"]["content_type"], got["Film"]["season"], got["Film"]["episode_title"]) == ("movie", None, None)
    assert got["A: B: Saison x"]["watch_date"] is None and got["A: B: Saison x"]["season"] is None


def test_play_history(spark, tmp_path):
    def play(ts, track, ms, **more):
        return {"ts": ts, "master_metadata_track_name": track, "master_metadata_album_artist_name": "A", "ms_played": ms,
                "spotify_track_uri": "spotify:track:1", "skipped": None, "shuffle": True} | more

    extended = write(tmp_path / "e.json", [
        play("2024-01-05T23:10:12Z", "one", 30000), play("2024-01-05T23:20:12Z", "short", 29999),
        play("2024-01-05T23:30:12Z", None, 90000), play("bad", "two", 90000)])
    account = write(tmp_path / "a.json", [
        {"endTime": "2024-01-05 23:10", "artistName": "A", "trackName": "one", "msPlayed": 31000},
        {"endTime": "2024-01-05 23:11", "artistName": "A", "trackName": "one", "msPlayed": 32000}])
    got = music.play_history(spark, extended, account)
    assert rows(got, "trackName", "msPlayed", "trackUri", "is_night", "minutes_played") == [
        ("one", 30000, "spotify:track:1", True, 0.5), ("one", 32000, None, True, 0.53)]


def test_music_lists_and_searches(spark, tmp_path):
    library = write(tmp_path / "l.json", {"tracks": [{"artist": "A", "album": "B", "track": "T", "uri": "u"}, {"track": None}]})
    assert rows(music.library(spark, library), "trackName", "trackUri") == [("T", "u")]
    playlist = write(tmp_path / "p.json", {"playlists": [
        {"name": "P", "lastModifiedDate": "2024-01-01", "items": [
            {"addedDate": "2024-01-02", "track": {"trackName": "T", "trackUri": "u"}}, {"track": {"trackName": None}}]},
        {"name": "empty", "items": []}]})
    assert rows(music.playlists(spark, playlist), "playlistName", "trackUri", "addedDate") == [("P", "u", dt.date(2024, 1, 2))]
    search = write(tmp_path / "s.json", [
        {"searchQuery": " jazz ", "searchTime": "2024-01-05T10:11:12.123Z[UTC]", "platform": "X"},
        {"searchQuery": "", "searchTime": "2024-01-05T10:11:12.123Z[UTC]"}, {"searchQuery": "x", "searchTime": "never"}])
    assert rows(music.searches(spark, search), "query", "event_hour", "event_weekday") == [("jazz", 10, 6)]


def test_social_comments_and_lists(spark, tmp_path):
    comment = {"string_map_data": {"Comment": {"value": "été 😀😀 ok 🎉"}, "Time": {"timestamp": 1704412800}}}
    empty = {"string_map_data": {"Comment": {"value": ""}, "Media Owner": {"value": "x"}}}
    path = write(tmp_path / "c.json", [comment, empty])
    got = social.comments(spark, path).collect()
    assert [(r["text"], r["media_owner"], r["event_month"], r["word_count"], r["nonascii_token_count"], r["emoji_count"]) for r in got] == [
        ("été 😀😀 ok 🎉", "", "2024-01", 4, 4, 3)]
    likes = write(tmp_path / "likes.json", [
        {"timestamp": 5, "label_values": [{"label": "Name", "value": "n"}, {"label": "URL", "href": "h"}]},
        {"timestamp": 6, "label_values": []}])
    assert rows(social.likes(spark, likes), "timestamp", "post_url") == [(5, "h"), (6, "")]
    saved = write(tmp_path / "saved.json", {"saved_saved_media": [
        {"title": "me", "string_map_data": {"Saved on": {"href": "h", "timestamp": 9}}}]})
    assert rows(social.saved(spark, saved), "account", "post_href", "timestamp") == [("me", "h", 9)]


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: {"story_likes": x}, lambda x: {"story_activities_story_likes": x}])
def test_two_shapes_of_a_list(spark, tmp_path, wrap):
    path = write(tmp_path / "s.json", wrap([{"timestamp": 7}, {"timestamp": 0}]))
    assert rows(social.activity_list(spark, path, "story_likes"), "timestamp", "action_type") == [(7, "story_like")]
    search = write(tmp_path / "q.json", {"keyword_searches": [
        {"string_map_data": {"Recherche": {"value": "q"}, "Heure": {"timestamp": 3}}},
        {"title": "t", "string_map_data": {"Time": {"timestamp": 4}}}, {"title": "no time"}]})
    assert rows(social.searches(spark, search), "query", "timestamp") == [("q", 3), ("t", 4)]


def test_unknown_key_gives_nothing(spark, tmp_path):
    path = write(tmp_path / "s.json", {"other": [{"timestamp": 7}]})
    assert social.activity_list(spark, path, "posts_viewed").count() == 0


def test_social_messages(spark, tmp_path):
    damaged = "déjà".encode().decode("latin-1")
    two = [{"name": "a"}, {"name": "b"}]
    write(tmp_path / "inbox/bob_123/message_1.json", {"participants": two, "messages": [
        {"sender_name": "a", "timestamp_ms": 1, "content": damaged},
        {"sender_name": "b", "timestamp_ms": 2, "photos": [{"uri": "p"}]},
        {"sender_name": "b", "timestamp_ms": 3, "content": "Liked a message"},
        {"sender_name": "b", "timestamp_ms": 4, "content": "x", "is_unsent": True},
        {"sender_name": "b", "timestamp_ms": 5, "content": "look", "share": {"link": "l"}},
        {"sender_name": "b", "timestamp_ms": 6, "call_duration": 9, "content": "call"}, {"sender_name": "b", "timestamp_ms": 7}]})
    write(tmp_path / "inbox/bob_123/message_2.json", {"participants": two, "messages": [{"sender_name": "a", "timestamp_ms": 0, "content": "hi"}]})
    write(tmp_path / "inbox/group_9/message_1.json", {"participants": [*two, {"name": "c"}], "messages": [{"sender_name": "c", "timestamp_ms": 8, "content": "yo"}]})
    read = social.messages(spark, str(tmp_path / "inbox/*/message_*.json"))
    assert rows(read, "timestamp_ms", "msg_type", "is_group") == [
        (0, "text", False), (1, "text", False), (2, "photo", False), (3, "text", False), (4, "unsent", False),
        (5, "share", False), (6, "text", False), (7, "other", False), (8, "text", True)]
    assert rows(social.conversation_text(read), "timestamp_ms", "text") == [(0, "hi"), (1, "déjà"), (4, "x"), (8, "yo")]
    meta = social.message_meta(read, "salt")
    assert meta.select("conv_id").distinct().count() == 2 and "text" not in meta.columns


def test_first_existing_pattern(spark, tmp_path):
    write(tmp_path / "b/x.json", [])
    found = social.existing(spark, [str(tmp_path / "a/*.json"), str(tmp_path / "b/*.json")])
    assert [p.rsplit("/", 2)[1:] for p in found] == [["b", "x.json"]]
    assert social.existing(spark, [str(tmp_path / "none/*.json")]) == []


def test_clips(spark, tmp_path):
    export = clips.read(spark, write(tmp_path / "t.json", {
        "Your Activity": {"Watch History": {"VideoList": [
            {"Link": "https://t/video/12", "Date": "2024-01-05 10:11:12"}, {"Link": "https://t/none", "Date": "bad"}]},
            "Searches": {"SearchList": [{"SearchTerm": "", "Date": "2024-01-05 10:11:12"}, {"SearchTerm": "two words", "Date": ""}]}},
        "Likes and Favorites": {"Like List": {"ItemFavoriteList": [{"link": "https://t/video/7/", "date": "2024-01-05 00:00:00"}]},
                                "Favorite Hashtags": {"FavoriteHashtagList": [{"HashtagName": ""}, {"hashtag": "h"}]}},
        "Comment": {"Comments": {"CommentsList": [{"comment": "c", "date": "2024-01-05 00:00:00"}]}},
        "Direct Message": {"Direct Messages": {"ChatHistory": {
            "with bob": [{"Date": "2024-01-05 00:00:00", "From": "me", "Content": "hello"},
                         {"Date": "2024-01-05 00:00:01", "From": "me", "Content": "http://x"}, {"Date": "x", "From": "bob"}],
            "broken": "text"}}},
        "Ads": {"Interests": {"adInterestCategories": ["Cars", {"Name": "Food"}, {"category": "Fun"}]}}}))
    assert rows(clips.actions(export, "watch"), "video_id", "timestamp_ms") == [("", 0), ("12", 1704449472000)]
    assert rows(clips.actions(export, "like"), "video_id", "event_hour") == [("7", 0)]
    assert clips.actions(export, "save").count() == 0
    assert rows(clips.searches(export), "query", "word_count") == [("", 0), ("two words", 2)]
    assert rows(clips.comments(export), "text", "content_type") == [("c", "comment")]
    messages = clips.messages(export, "me")
    assert rows(messages, "msg_type", "is_me", "timestamp_ms") == [("other", False, 0), ("text", True, 1704412800000), ("url", True, 1704412801000)]
    assert rows(clips.own_text(messages), "text") == [("hello",)]
    assert clips.message_meta(messages, "s").count() == 3
    assert rows(clips.hashtags(export), "hashtag") == [("h",)]
    assert rows(clips.ad_interests(export), "category") == [("Cars",), ("Food",), ("Fun",)]


def test_posts(spark, tmp_path):
    tweet = {"full_text": "@a @b réponse", "created_at": "Fri Jan 05 10:11:12 +0000 2024", "id_str": "1", "lang": "fr",
             "in_reply_to_status_id_str": "9", "retweet_count": "3", "entities": {
                 "hashtags": [{"text": "Foo"}, {"text": "Bar"}], "urls": [{"expanded_url": "u"}], "media": [{"id": 1}]}}
    path = write(tmp_path / "tweets.js", "window.YTD.tweets.part0 = " + json.dumps(
        [{"tweet": tweet}, {"tweet": {"full_text": "RT @x: hi", "id_str": "2"}}, {"full_text": "bare", "id_str": "3", "created_at": "?"}]))
    got = {r["tweet_id"]: r for r in posts.tweets(spark, path).collect()}
    assert (got["1"]["text"], got["1"]["is_reply"], got["1"]["has_media"], got["1"]["hashtags"], got["1"]["retweet_count"]) == (
        "réponse", True, True, "foo bar", 3)
    assert got["1"]["timestamp_ms"] == 1704449472000 and got["1"]["word_count"] == 1
    assert got["2"]["is_retweet"] and not got["2"]["is_reply"] and got["2"]["hashtags"] == ""
    assert got["3"]["text"] == "bare" and got["3"]["timestamp_ms"] == 0
    likes = write(tmp_path / "like.js", 'window.YTD.like.part0 = [{"like": {"tweetId": "5", "fullText": "a b"}}]')
    assert rows(posts.likes(spark, likes), "tweet_id", "word_count", "post_url") == [("5", 2, "")]
    saved = write(tmp_path / "s.js", 'window.YTD.saved.part0 = [{"savedSearch": {"query": "q"}}, {"query": "r"}, {}]')
    assert rows(posts.saved_searches(spark, saved), "query") == [("q",), ("r",)]


def cell(body):
    return f'<div class="outer-cell mdl-cell"><div><div class="content-cell mdl-1">{body}</div></div></div>\n'


def test_activity_page(spark, tmp_path):
    long_url = "https://www.youtube.com/watch?v=abcdefghijk&pad=" + "x" * 400
    page = "<html><body>" + "".join([
        cell(f'Vous avez regardé <a href="{long_url}">A &amp; B</a><br><a href="https://www.youtube.com/channel/1">Chan</a><br>5 janv. 2024, 10:11:12 CET'),
        cell('<a href="https://www.google.com/search?q=deux+mots&x=1">deux mots</a><br>14 août 2023, 00:00:01 CEST'),
        cell("sans lien<br>3 févr. 2022, 07:08:09 UTC"), cell("rien du tout"), cell('<a href="https://googleadservices.com/?v=abcdefghijk">Pub</a>5 brumaire 2024, 10:11:12'),
    ]) + "</body></html>"
    got = activity_html.activity(spark, write(tmp_path / "a.html", page), "youtube_watch")
    found = {r["title"]: r for r in got.collect()}
    assert set(found) == {"A & B", "deux mots", "", "Pub"}
    assert found["A & B"]["author"] == "Chan" and found["A & B"]["url"] == long_url
    assert found["A & B"]["timestamp_ms"] == 1704449472000 and found["Pub"]["timestamp_ms"] == 0
    assert found["deux mots"]["event_month"] == "2023-08" and found[""]["event_hour"] == 7
    assert [r["query"] for r in activity_html.searches(got).filter("title = 'deux mots'").collect()] == ["deux mots"]
    assert [r["title"] for r in activity_html.watched_videos(got).collect()] == ["A & B"]
    assert [r["domain"] for r in activity_html.visits(got).filter("title = 'deux mots'").collect()] == ["google.com"]
    assert activity_html.video_searches(got).filter("title = ''").count() == 0


def test_manifest(spark, tmp_path):
    inbox = tmp_path / "inbox"
    for name, text in {
        "instagram-b/likes/l.json": "new", "Instagram-A/likes/l.json": "old", "TikTok_Data_1/u.json": "1", "TikTok_Data_2/u.json": "22",
        "takeout-1/Takeout/My Activity/a.html": "x", "Spotify Account Data/h.json": "", "Spotify Extended Streaming History/h.json": "y",
        "twitter-1/readme.txt": "t", "unknown/x.json": "z", "NetflixViewingHistory.csv": "Title,Date",
    }.items():
        write(inbox / name, text)
    files = manifest.scan(spark, str(inbox))
    assert rows(manifest.choose(files), "source", "target", "folder") == [
        ("GOOGLE", "My Activity/a.html", "takeout-1"), ("INSTAGRAM", "likes/l.json", "Instagram-A"),
        ("NETFLIX", "NetflixViewingHistory.csv", ""), ("SPOTIFY", "account/h.json", "Spotify Account Data"),
        ("SPOTIFY", "extended/h.json", "Spotify Extended Streaming History"), ("TIKTOK", "u.json", "TikTok_Data_2"),
        ("X", "readme.txt", "twitter-1")]
    assert rows(manifest.findings(files), "source", "level") == [("SPOTIFY", "error"), ("X", "warning")]


@pytest.mark.parametrize("folder, source", [
    ("instagram-x", "INSTAGRAM"), ("TAKEOUT-2024", "GOOGLE"), ("TikTok_Data", "TIKTOK"), ("twitter-1", "X"), ("Spotify Account Data", "SPOTIFY"),
    ("facebook", None), ("my-instagram", None)])
def test_source_of_a_folder(spark, folder, source):
    assert spark.range(1).select(manifest.source_of(F.lit(folder))).first()[0] == source


def test_photos(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/IMG_1.jpg").write_bytes(b"not an image")
    (tmp_path / "note.txt").write_text("x")
    found = images.photos(spark, str(tmp_path))
    assert rows(found, "photo_id", "filename") == [("IMG_1", "IMG_1.jpg")]
    if importlib.util.find_spec("PIL"):
        assert rows(images.exif(found), "lat", "has_gps", "exif_date") == [(None, False, None)]
        assert "Error" in images.exif(found).first()["problem"]
    else:  # no silent nulls
        with pytest.raises(Exception, match="PIL"):
            images.exif(found).collect()


def test_tags_and_examples(spark, tmp_path):
    library = tags.music_library(spark, write(tmp_path / "lib.json", [
        {"track_id": "1", "moments": ["old"]}, {"track_id": "2", "moments": []}, {"track_id": "3"}]))
    write(tmp_path / "r/a.txt", '```json\n{"1": ["sun", "sea"], "3": null, "9": ["x"]}\n```')
    write(tmp_path / "r/b.txt", "sorry")
    applied = tags.apply_tags(library, tags.replies(spark, str(tmp_path / "r")))
    assert {r["track_id"]: r["moments"] for r in applied.collect()} == {"1": ["sun", "sea"], "2": [], "3": None}
    lines = write(tmp_path / "x.jsonl", '{"messages":[{"role":"user","content":"a"}]}\n\n{"broken\n{"messages":[]}\n')
    assert tags.examples(spark, lines).count() == 2
