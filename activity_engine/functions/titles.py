"""Film titles and conversation labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_parts(title: Column) -> dict[str, Column]:
    """Series or movie, show, season and episode of a ``Show: Saison n: Episode`` title."""
    series = title.contains(":")
    pieces = F.split(title, ":")
    return {
        "content_type": F.when(series, "series").otherwise("movie"),
        "show_title": F.when(series, F.trim(F.get(pieces, F.lit(0)))).otherwise(title),
        "season": F.when(series, F.regexp_extract(title, r"Saison.(\d+)", 1).try_cast("int")),
        "episode_title": F.when(series, F.trim(F.element_at(pieces, -1))),
    }


def label_from_id(conversation: Column) -> Column:
    """Name in front of the long number that ends a conversation id."""
    return F.lower(F.regexp_replace(conversation, r"_\d{10,}.*$", ""))
