"""Course-local dates and times as Column expressions. Instants are timestamps in a session pinned to UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_iso_date(text: Column) -> Column:
    """A real calendar day as YYYY-MM-DD."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (text.try_cast("date").cast("string") == text), F.lit(False))


def is_time(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.lit(False))


def is_year_month(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.lit(False))


def month_index(year_month: Column) -> Column:
    return F.substring(year_month, 1, 4).cast("int") * 12 + F.substring(year_month, 6, 2).cast("int")


def month_gap(a: Column, b: Column) -> Column:
    return F.abs(month_index(a) - month_index(b))


def add_months(year_month: Column, months: int | Column) -> Column:
    total = month_index(year_month) - 1 + months
    return F.concat(F.lpad(F.floor(total / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.pmod(total, F.lit(12)) + 1).cast("string"), 2, "0"))


def add_days(day: Column, days: int | Column) -> Column:
    return F.date_add(day.cast("date"), days).cast("string")


def local_today(now: Column, zone: Column) -> Column:
    """The day that the zone's calendars show at an instant, whatever the session's own zone."""
    seconds = F.unix_seconds(F.from_utc_timestamp(now, zone))
    return F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")).cast("string")


def offset_seconds(at: Column, zone: Column) -> Column:
    """How far the zone's clocks are ahead of UTC at an instant."""
    return F.unix_seconds(F.from_utc_timestamp(at, zone)) - F.unix_seconds(at)


def wall_time_to_utc(day: Column, time: Column, zone: Column) -> Column:
    """The instant at which the zone's clocks show this. Two rounds settle the offset; in the gap of spring the earlier reading wins, in the overlap of autumn the first."""
    of_day = F.split_part(time, F.lit(":"), F.lit(1)).cast("int") * 3600 + F.split_part(time, F.lit(":"), F.lit(2)).cast("int") * 60
    naive = (F.unix_date(day.cast("date")).cast("long") * 86_400 + of_day).cast("long")
    guess = naive - offset_seconds(F.timestamp_seconds(naive), zone)
    return F.timestamp_seconds(naive - offset_seconds(F.timestamp_seconds(guess), zone))


def zoned_iso(day: Column, time: Column, zone: Column) -> Column:
    minutes = F.round(offset_seconds(wall_time_to_utc(day, time, zone), zone) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), time, F.lit(":00"), sign, two(F.floor(F.abs(minutes) / 60)), F.lit(":"), two(F.abs(minutes) % 60))


def is_past(start: Column, end: Column, now: Column, zone: Column) -> Column:
    return local_today(now, zone) > F.coalesce(end, start)


def recheck_due(start: Column, last_verified: Column, now: Column, zone: Column) -> Column:
    """After 7 days when the event is over 30 days away, else after 48 hours; never once it has begun."""
    days = F.datediff(start.cast("date"), local_today(now, zone).cast("date"))
    age = F.unix_seconds(now) - F.unix_seconds(last_verified)
    return F.coalesce((days >= 0) & (age >= F.when(days > 30, 7 * 86_400).otherwise(2 * 86_400)), F.lit(False))
