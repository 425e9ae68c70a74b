"""Time as column expressions. `now` is always handed in; nothing reads the wall clock."""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_US = 86_400_000_000
_HOUR_US = 3_600_000_000
MONTHS_LONG = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
)


def at(now: "datetime | str | Column") -> Column:
    """A pinned instant as a column."""
    if isinstance(now, Column):
        return now
    return F.to_timestamp(F.lit(str(now)))


def micros_between(a: Column, b: Column) -> Column:
    return F.unix_micros(b) - F.unix_micros(a)


def days_exact(a: Column, b: Column) -> Column:
    """Elapsed days from a to b, as a double."""
    return micros_between(a, b) / F.lit(float(_DAY_US))


def hours_exact(a: Column, b: Column) -> Column:
    return micros_between(a, b) / F.lit(float(_HOUR_US))


def days_between(a: Column, b: Column) -> Column:
    """Whole elapsed days, floored."""
    return F.floor(days_exact(a, b))


def minus_days(moment: Column, days) -> Column:
    days = days if isinstance(days, Column) else F.lit(days)
    return F.timestamp_micros(F.unix_micros(moment) - days.cast("bigint") * F.lit(_DAY_US))


def plus_days(moment: Column, days) -> Column:
    """Add days, whole or fractional."""
    days = days if isinstance(days, Column) else F.lit(days)
    return F.timestamp_micros(
        F.unix_micros(moment) + F.round(days * F.lit(float(_DAY_US))).cast("bigint")
    )


def plus_hours(moment: Column, hours: int) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) + F.lit(hours * _HOUR_US))


def iso_z(moment: Column) -> Column:
    """2026-08-13T09:41:07.482Z"""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def moment(text: Column) -> Column:
    """An ISO instant or date out of a payload; anything else is null."""
    return text.try_cast("timestamp")


def local(ts: Column, tz: Column) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_date(ts: Column, tz: Column) -> Column:
    return F.to_date(local(ts, tz))


def minute_of_day(local_ts: Column) -> Column:
    return F.hour(local_ts) * 60 + F.minute(local_ts)


def _minutes(hhmm: str) -> int:
    hours, minutes = hhmm.strip().split(":")
    return int(hours) * 60 + int(minutes)


def is_quiet_hour(ts: Column, tz: Column, start: str, end: str) -> Column:
    """Inside the local quiet window, which may wrap past midnight."""
    low, high = _minutes(start), _minutes(end)
    here = minute_of_day(local(ts, tz))
    if low <= high:
        return (here >= low) & (here < high)
    return (here >= low) | (here < high)


def next_deliverable_at(ts: Column, tz: Column, start: str, end: str) -> Column:
    """The first instant at or after ts outside the quiet window."""
    clock_end = F.make_dt_interval(F.lit(0), F.lit(_minutes(end) // 60), F.lit(_minutes(end) % 60))
    midnight = F.date_trunc("day", local(ts, tz))
    today = F.to_utc_timestamp(midnight + clock_end, tz)
    tomorrow = F.to_utc_timestamp(midnight + F.expr("INTERVAL 1 DAY") + clock_end, tz)
    return (
        F.when(~is_quiet_hour(ts, tz, start, end), ts)
        .when(today > ts, today)
        .otherwise(tomorrow)
    )


def relative_future(now: Column, then: Column) -> Column:
    hours = hours_exact(now, then)
    days = F.bround(hours / 24).cast("int")
    return (
        F.when(hours < 0, "overdue")
        .when(hours < 1, "within the hour")
        .when(hours < 24, F.format_string("in %d hours", F.bround(hours).cast("int")))
        .when(days == 1, "tomorrow")
        .otherwise(F.format_string("in %d days", days))
    )


def relative_past(now: Column, then: Column) -> Column:
    days = days_between(then, now)
    return (
        F.when(days <= 0, "today")
        .when(days == 1, "1 day quiet")
        .otherwise(F.format_string("%d days quiet", days))
    )


def weekday_long(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def date_eyebrow(now: Column, tz: Column) -> Column:
    """Thursday 30 July, in the zone of the tenant."""
    return F.date_format(local(now, tz), "EEEE d MMMM")
