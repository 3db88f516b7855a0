"""Date and time expressions on zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
DAY_SECONDS = 86_400


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp, whatever the session zone."""
    since = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(18,6)") * F.lit(MICROS)).cast("bigint")


def micros_between(start: Column, end: Column) -> Column:
    return epoch_micros(end) - epoch_micros(start)


def seconds_between(start: Column, end: Column) -> Column:
    """Number of whole-second boundaries crossed from start to end."""
    return floor_div(epoch_micros(end), MICROS) - floor_div(epoch_micros(start), MICROS)


def duration_seconds(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS))


def floor_div(value: Column, width: int) -> Column:
    """Exact floor division of a bigint column (also right below zero)."""
    w = F.lit(width).cast("bigint")
    return F.call_function("div", value - F.pmod(value, w), w)


def time_cell(ts: Column, width_seconds: float) -> Column:
    """Index of the fixed-width time cell holding ``ts``."""
    return floor_div(epoch_micros(ts), int(round(width_seconds * MICROS)))


def plus_seconds(ts: Column, seconds: Column | float) -> Column:
    secs = seconds if isinstance(seconds, Column) else F.lit(seconds)
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, zero, secs.cast("decimal(18,6)"))


def to_zoneless(value: Column) -> Column:
    return value.cast("timestamp_ntz")


def date_with_seconds(day: Column, seconds: Column) -> Column:
    """Midnight of ``day`` plus a second count; NULL when either part is missing."""
    return F.when(day.isNotNull() & seconds.isNotNull(), plus_seconds(to_zoneless(day), seconds))


def completed_years(born: Column, at: Column) -> Column:
    """Age in completed years: calendar-year difference, one less before the birthday."""
    before_birthday = F.month(at) * 100 + F.day(at) < F.month(born) * 100 + F.day(born)
    return F.year(at) - F.year(born) - before_birthday.cast("int")


def days_if_within(start: Column, end: Column, low: int, high: int) -> Column:
    gap = F.datediff(end, start)
    return F.when(gap.between(low, high), gap)


def date_from_digits(digits: Column) -> Column:
    """First eight digits read as yyyyMMdd; impossible dates give NULL."""
    head = F.substring(digits, 1, 8)
    dashed = F.concat_ws("-", F.substring(head, 1, 4), F.substring(head, 5, 2), F.substring(head, 7, 2))
    return F.when(F.length(head) == 8, dashed.try_cast("date"))


def clock_text_to_timestamp(text: Column) -> Column:
    """Month/day/year twelve-hour clock text, one or two digits per field."""
    return F.try_to_timestamp(text, F.lit("M/d/yyyy h:m:s a")).cast("timestamp_ntz")


def lenient_date(value: Column) -> Column:
    """Date of a timestamp, date or ISO text value; unreadable text gives NULL."""
    return F.substring(value.cast("string"), 1, 10).try_cast("date")
