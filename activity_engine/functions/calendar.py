"""Calendar columns: parts of an instant, day slots, seasons, labels, and the date formats of the exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hours at which a day slot starts, per use.
PROFILE_CUTS = ((5, "morning"), (12, "afternoon"), (18, "evening"), (23, "night"))
SCENE_CUTS = ((6, "Matin"), (12, "Après-midi"), (18, "Soirée"), (23, "Nuit"))
PERIOD_CUTS = ((5, "Matin"), (12, "Apres-midi"), (18, "Soir"), (23, "Nuit"))
CONTEXT_CUTS = (
    (0, "late night dark quiet"),
    (6, "morning fresh start energy"),
    (12, "afternoon chill sunny"),
    (18, "evening friends social vibes"),
    (23, "night out party"),
)

# Month abbreviations used in labels.
MONTH_LABELS = ("jan", "fév", "mar", "avr", "mai", "juin", "juil", "août", "sep", "oct", "nov", "déc")

# Prefixes that identify a French month name, in calendar order.
FRENCH_MONTH_PREFIXES = ("janv", "févr", "mars", "avr", "mai", "juin", "juil", "août", "sept", "oct", "nov", "déc")

# Timestamp formats of the export files.
ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ISO_MILLIS_ZONE = "yyyy-MM-dd'T'HH:mm:ss.SSSX"
MINUTE = "yyyy-MM-dd HH:mm"
SECOND = "yyyy-MM-dd HH:mm:ss"
EXIF = "yyyy:MM:dd HH:mm:ss"
SHORT_US_DATE = "M/d/yy"
POST_DATE = "MMM dd HH:mm:ss Z yyyy"  # after the weekday name is removed

SATURDAY_SUNDAY = (7, 1)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def from_epoch_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Year, ``yyyy-MM`` month, hour, weekday (1 = Sunday) and ISO week of an instant."""
    return {
        "event_year": F.year(ts),
        "event_month": F.date_format(ts, "yyyy-MM"),
        "event_hour": F.hour(ts),
        "event_weekday": F.dayofweek(ts),
        "event_week": F.weekofyear(ts),
    }


def with_event_columns(df, ts: Column):
    """Add the ``event_*`` columns every activity table carries."""
    parts = calendar_parts(ts)
    parts.pop("event_week")
    return df.withColumns({"event_date": ts} | parts)


def day_slot(hour: Column, cuts: Sequence[tuple[int, str]]) -> Column:
    """Label of the slot an hour falls in. Hours before the first cut belong to the last slot."""
    label = F.lit(cuts[-1][1])
    for (start, name), (end, _) in zip(cuts, cuts[1:]):
        label = F.when((hour >= start) & (hour < end), F.lit(name)).otherwise(label)
    return label


def is_weekend(weekday: Column, days: Sequence[int] = SATURDAY_SUNDAY) -> Column:
    return weekday.isin(*days)


def is_night(hour: Column) -> Column:
    """22:00 to 05:59, the night of the play tables."""
    return (hour >= 22) | (hour <= 5)


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .otherwise("autumn")
    )


def time_context(ts: Column) -> Column:
    """Slot words and season of an instant, the phrase compared with tag texts."""
    return F.when(
        ts.isNotNull(), F.concat_ws(" ", day_slot(F.hour(ts), CONTEXT_CUTS), season(F.month(ts)))
    ).otherwise(F.lit(""))


def month_label(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_LABELS]), month)


def scene_label(ts: Column) -> Column:
    """``slot · day month year`` of a scene's first instant."""
    day = F.concat_ws(" ", F.dayofmonth(ts), month_label(F.month(ts)), F.year(ts))
    return F.concat_ws(" · ", day_slot(F.hour(ts), SCENE_CUTS), day)


def parse_post_date(text: Column) -> Column:
    """``Wed Oct 10 20:19:24 +0000 2018``; the strict parser takes no weekday name, so it is removed first."""
    return F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3} ", ""), F.lit(POST_DATE))


def parse_search_time(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, r"\[UTC\]$", ""), F.lit(ISO_MILLIS_ZONE))


def parse_millis(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` to epoch milliseconds, 0 when unreadable."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(F.trim(text), F.lit(SECOND))), F.lit(0).cast("long"))


_FRENCH = r"(\d{1,2})\s+([\p{L}]+)\.?\s+(\d{4}),?\s+(\d{2}):(\d{2}):(\d{2})"


def french_date_millis(text: Column) -> Column:
    """Epoch milliseconds of the first French date in a text, 0 when there is none or it is impossible."""
    word = F.lower(F.regexp_extract(text, _FRENCH, 2))
    month = F.lit(None).cast("int")
    for number, prefix in reversed(list(enumerate(FRENCH_MONTH_PREFIXES, 1))):
        month = F.when(word.startswith(prefix), F.lit(number)).otherwise(month)

    numbers = [F.regexp_extract(text, _FRENCH, g).try_cast("int") for g in (3, 1, 4, 5, 6)]
    year, day, hour, minute, second = numbers
    made = F.try_make_timestamp(year, month, day, hour, minute, second.cast("decimal(8,6)"))
    return F.coalesce(F.unix_millis(made), F.lit(0).cast("long"))


def filename_date(name: Column) -> Column:
    """Noon of the date written in a file name: ``yyyymmdd_hhmmss``, ``yyyy-mm-dd`` or eight digits on their own."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    candidates = [
        F.regexp_extract(base, r"(\d{8})_\d{6}", 1),
        F.regexp_replace(F.regexp_extract(base, r"(\d{4}-\d{2}-\d{2})", 1), "-", ""),
        F.regexp_extract(base, r"(?:^|[^0-9])(\d{8})(?:[^0-9]|$)", 1),
    ]
    days = [F.try_to_date(c, "yyyyMMdd") for c in candidates]
    valid = [F.when(F.year(d).between(2000, 2030), d) for d in days]
    return F.coalesce(*valid).cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(hemisphere.isin("S", "W"), -value).otherwise(value)


def month_weeks(month_start: Column) -> Column:
    """Array of (week_start, week_end, shown_start, shown_end) for the Monday weeks that touch a month."""
    last = F.last_day(month_start)
    monday = F.to_date(F.date_trunc("week", month_start))
    return F.transform(
        F.sequence(monday, last, F.expr("INTERVAL 7 DAYS")),
        lambda d: F.struct(
            d.alias("week_start"),
            F.date_add(d, 6).alias("week_end"),
            F.greatest(d, month_start).alias("shown_start"),
            F.least(F.date_add(d, 6), last).alias("shown_end"),
        ),
    )
