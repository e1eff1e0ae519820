"""Camera time has no zone (TIMESTAMP_NTZ); audit time is an instant (TIMESTAMP). They are never mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exif_time(raw: Column) -> Column:
    """"YYYY:MM:DD HH:MM:SS" with NULs and spaces around it; null if it isn't that."""
    clean = F.regexp_replace(raw, r"^[\x00\s]+|[\x00\s]+$", "")
    return F.when(clean.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), F.concat(F.replace(F.substring(clean, 1, 10), F.lit(":"), F.lit("-")), F.substring(clean, 11, 9)).try_cast("timestamp_ntz"))


def session_name(at: Column) -> Column:
    return F.concat(F.lit("Session - "), F.date_format(at, "yyyy-MM-dd HH:mm"))


def display_time(raw: Column) -> Column:
    return F.coalesce(F.date_format(raw.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), raw)


def age_days(at: Column, now: Column) -> Column:
    return F.greatest(F.datediff(now, at), F.lit(0))


def span_days(first: Column, last: Column) -> Column:
    """Days from first to last, both counted."""
    return F.datediff(last, first) + 1


def has_image_range(start: Column, end: Column, created: Column) -> Column:
    """False for the placeholder range of a session without images: both ends alike and within 2 s of its creation."""
    gap = F.abs(F.unix_millis(start.cast("timestamp")) - F.unix_millis(created))
    return ~((start == end) & (gap <= 2000))


def session_stage(status: Column, has_images: Column) -> Column:
    return F.when(status == "archived", 3).when(has_images, 3).otherwise(2)


def duration_text(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def parsed_time(raw: Column, default: Column) -> Column:
    """An instant; digits of a second beyond the third are cut, and what isn't a time gives ``default``."""
    return F.coalesce(F.regexp_replace(raw, r"(\.\d{3})\d+", "$1").try_cast("timestamp"), default)


def camera_time(raw: Column) -> Column:
    """A time without zone, to the millisecond; null if it isn't one."""
    return F.regexp_replace(raw, r"(\.\d{3})\d+", "$1").try_cast("timestamp_ntz")


def stored_time(at: Column) -> Column:
    """Camera time as text that ``camera_time`` reads back."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end, never negative."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return F.greatest(ms(end) - ms(start), F.lit(0))
