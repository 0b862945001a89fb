"""Dates and times of day (D01-D11). The reference time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_bucket(as_of: Column, day: Column) -> Column:
    """Days since, in bands."""
    days = F.datediff(as_of, day)
    return F.when(day.isNull(), "never").when(days <= 30, "30").when(days <= 90, "90").when(days <= 180, "180").when(days <= 365, "365").otherwise("older")


def minutes(c: Column) -> Column:
    """'HH:MM' as a minute of the day, 24:00 included, null otherwise."""
    hour, minute = (F.regexp_extract(c, r"^\s*(\d{1,2}):(\d{2})\s*$", k).try_cast("int") for k in (1, 2))
    return F.when((minute < 60) & (hour * 60 + minute <= 1440), hour * 60 + minute)


def long_minutes(c: Column) -> Column:
    """'HH:MM' with hours beyond 24 for the night after."""
    hour, minute = (F.regexp_extract(c, r"^\s*(\d{1,2}):(\d{2})\s*$", k).try_cast("int") for k in (1, 2))
    return F.when(minute < 60, hour * 60 + minute)


def weekday(c: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(c) - 1


def loose_date(c: Column, default: Column) -> Column:
    """yymmdd, else yyyy-mm-dd or yyyy/mm/dd, else the default."""
    s = F.trim(c)
    return F.coalesce(F.try_to_date(F.when(s.rlike(r"^\d{6}$"), F.concat(F.lit("20"), s)), "yyyyMMdd"), F.try_to_date(F.replace(s, F.lit("/"), F.lit("-")), "yyyy-MM-dd"), default)


def closing_instant(day: Column, open_min: Column, close_min: Column) -> Column:
    """When hours that open on ``day`` end: a close at or before the opening is on the next day."""
    end = F.when(close_min <= open_min, close_min + 1440).otherwise(close_min)
    return F.timestamp_add("MINUTE", end, day.cast("timestamp_ntz"))


def closing_soon(now_min: Column, close_min: Column, within: int = 120) -> Column:
    """Minutes until closing if at most ``within``, else null."""
    left = close_min - now_min
    return F.when((left > 0) & (left <= within), left)


def epoch_seconds(c: Column) -> Column:
    """Seconds of an epoch number given in micro-, milli- or whole seconds, told apart by size."""
    return F.when(c > 10**15, F.floor(c / 10**6)).when(c > 10**12, F.floor(c / 10**3)).otherwise(c).cast("long")


def iso_micros(c: Column) -> Column:
    """ISO 8601 in UTC with six decimals."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def visitor_hash(ip: Column, agent: Column, salt: str, day: Column) -> Column:
    """Hash that changes daily, so visitors cannot be followed."""
    return F.sha2(F.concat_ws("|", ip, agent, F.concat(F.lit(salt), day.cast("string"))), 256)
