"""Parts of urls and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def search_query(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"[?&]q=([^&]+)", 1), r"\+", " ")


def domain(url: Column) -> Column:
    return F.regexp_extract(url, r"https?://(?:www\.)?([^/]+)", 1)


def query_value(url: Column, name: str) -> Column:
    return F.regexp_extract(url, rf"[?&]{name}=([^&#]+)", 1)


def video_id(url: Column) -> Column:
    return F.regexp_extract(url, r"[?&]v=([a-zA-Z0-9_-]{11})", 1)


def clip_id(url: Column) -> Column:
    return F.regexp_extract(url, r"video/(\d+)", 1)


def track_uri(track: Column) -> Column:
    prefix = "spotify:track:"
    return F.when(track.startswith(prefix) | (track == ""), track).otherwise(F.concat(F.lit(prefix), track))


def rewrite_root(path: Column, root_pattern: str, new_root: str) -> Column:
    """Replace a leading folder and percent-encode what follows, keeping the slashes."""
    rest = F.regexp_replace(path, root_pattern, "")
    encoded = F.replace(F.replace(F.url_encode(rest), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(new_root), encoded)
