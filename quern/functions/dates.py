"""Tolerant dates and timestamps; UTC throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_date(text: Column) -> Column:
    """The date of the first ten characters; null where they are none."""
    return F.try_to_date(F.substring(text, 1, 10))


def first_filled(*texts: Column) -> Column:
    """The first that is neither null nor empty; a later one is not asked because an earlier does not parse."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def iso_unix(text: Column) -> Column:
    """Whole epoch seconds of an ISO timestamp; a naive one is UTC; null where it is none."""
    return F.try_to_timestamp(text).cast("long")


def normalised(text: Column, date_only: bool) -> Column:
    """Date-only values cut to ten characters; timestamps with T in place of the blank."""
    return F.substring(text, 1, 10) if date_only else F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}) ", "$1T")


def iso_z(unix: Column) -> Column:
    return F.date_format(F.timestamp_seconds(unix), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def session_date(unix: Column, zone: str = "UTC") -> Column:
    """The day of a time where the reader is."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(F.timestamp_seconds(unix), F.current_timezone()).cast("timestamp_ntz")), "yyyy-MM-dd")
