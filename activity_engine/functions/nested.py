"""JSON strings, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_value(text: Column, path: str, default=None) -> Column:
    value = F.get_json_object(text, path)
    return value if default is None else F.coalesce(value, F.lit(default))


def unfence(text: Column) -> Column:
    """A reply without the code fence around it."""
    return F.trim(F.regexp_replace(text, r"^\s*```[a-z]*\s*|\s*```\s*$", ""))


def reply_tags(text: Column) -> Column:
    """``{id: [tags]}`` map of a JSON reply, fenced or not; null when it is not JSON."""
    return F.from_json(unfence(text), "map<string,array<string>>")


def unwrap_js(text: Column) -> Column:
    """JSON part of ``window.YTD.name.part0 = [...]``."""
    return F.regexp_replace(F.trim(text), r"^window\.YTD\.\w+\.\w+\s*=\s*", "")


def ordered_union(*arrays: Column) -> Column:
    """Elements of all arrays in order, each once."""
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))


def without_empty(array: Column) -> Column:
    return F.array_remove(array, "")


def first_of_list(text: Column, separator: str = r"\|") -> Column:
    return F.get(F.split(text, separator), F.lit(0))
