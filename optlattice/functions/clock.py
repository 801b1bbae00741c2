"""Clocks. Stored instants are timestamps without zone that mean UTC, so no session setting changes a result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
#: Options expire at 20:00 UTC, and a year has 365.25 days.
EXPIRY_HOUR, YEAR_SECONDS = 20, 365.25 * 86400


def local(ts: Column, zone: str = NEW_YORK) -> Column:
    """The zone's wall clock at a UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def seconds_of_day(ts: Column) -> Column:
    """Hour and minute as seconds; seconds are left out, so a window's last minute belongs to it."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60


def at(hhmm: str) -> int:
    h, m = hhmm.split(":")[:2]
    return int(h) * 3600 + int(m) * 60


def in_window(local_ts: Column, start: str, end: str) -> Column:
    """Both ends belong to the window."""
    return seconds_of_day(local_ts).between(at(start), at(end))


def is_weekday(local_ts: Column) -> Column:
    return F.weekday(local_ts) < 5


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a UTC instant without zone, with a fraction."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("double")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")


def epoch_micros(ts: Column) -> Column:
    return F.round(epoch_seconds(ts) * 1_000_000).cast("long")


def minute_number(ts: Column) -> Column:
    """Whole minutes since 1970: the difference of two counts the minute boundaries between them."""
    return F.floor(epoch_seconds(ts) / 60).cast("long")


def dte(ts: Column, expiration: Column) -> Column:
    return F.datediff(expiration, F.to_date(ts))


def years_to_expiry(ts: Column, expiration: Column) -> Column:
    """Years until 20:00 UTC of the expiration date; 0 after it."""
    seconds = F.datediff(expiration, F.lit("1970-01-01").cast("date")) * 86400.0 + EXPIRY_HOUR * 3600 - epoch_seconds(ts)
    return F.greatest(F.lit(0.0), seconds / YEAR_SECONDS)


def from_epoch_nanos(ns: Column) -> Column:
    """UTC date of a count of nanoseconds; the sentinels 0 and 2^64 - 1 (and what no date can be) are null."""
    days = F.floor(ns / F.lit(86_400_000_000_000))
    return F.when((ns > 0) & (ns < 9_000_000_000_000_000_000), F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")))
