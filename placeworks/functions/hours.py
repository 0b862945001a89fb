"""Algebra of weekly opening hours: minutes of one weekday, ends open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = "array<struct<start:int,end:int>>"


def _range(a, b) -> Column:
    return F.struct(F.lit(a).cast("int").alias("start") if not isinstance(a, Column) else a.cast("int").alias("start"), F.lit(b).cast("int").alias("end") if not isinstance(b, Column) else b.cast("int").alias("end"))


def segments(opens: Column, closes: Column) -> Column:
    """Ranges of one weekday that hours cover: all day if both ends are equal, none from 24:00 to 24:00, and two,
    of the same weekday, if they run past midnight (I01)."""
    none = F.array().cast(RANGES)
    return (
        F.when(opens.isNull() | closes.isNull() | ((opens == 1440) & (closes == 1440)), none)
        .when(opens == closes, F.array(_range(0, 1440)))
        .when(opens == 1440, F.array(_range(0, closes)))
        .when(closes == 0, F.array(_range(opens, 1440)))
        .when(opens < closes, F.array(_range(opens, closes)))
        .otherwise(F.array(_range(0, closes), _range(opens, 1440)))
    )


def subtract(ranges: Column, taken: Column) -> Column:
    """The ranges without what ``taken`` covers."""

    def without(left: Column, t: Column) -> Column:
        parts = lambda r: F.array(_range(r["start"], F.least(r["end"], t["start"])), _range(F.greatest(r["start"], t["end"]), r["end"]))
        return F.filter(F.flatten(F.transform(left, parts)), lambda r: r["start"] < r["end"]).cast(RANGES)

    return F.aggregate(taken, ranges.cast(RANGES), without)


def merge(ranges: Column) -> Column:
    """Sorted ranges, those that touch or overlap made one, empty ones dropped."""
    ordered = F.array_sort(F.filter(ranges, lambda r: r["start"] < r["end"]))

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(_range(last["start"], F.greatest(last["end"], r["end"]))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= r["start"]), joined).otherwise(F.concat(done, F.array(r))).cast(RANGES)

    return F.aggregate(ordered, F.array().cast(RANGES), add)


def covers(ranges: Column, minute: Column) -> Column:
    """Whether a range holds the minute."""
    return F.exists(ranges, lambda r: (r["start"] <= minute) & (minute < r["end"]))


def text_ranges(text: Column, label: str) -> Column:
    """HH:MM-HH:MM pairs of the lines, or slash-separated parts, that contain a weekday's label."""
    parts = F.filter(F.split(F.regexp_replace(text, r"[(（][^()（）]*(?:喫煙|禁煙|smok)[^()（）]*[)）]", ""), r"[\n/]"), lambda x: x.contains(label))
    found = F.flatten(F.transform(parts, lambda x: F.regexp_extract_all(x, F.lit(r"(\d{1,2}:\d{2}\s*[-~〜–]\s*\d{1,2}:\d{2})"), F.lit(1))))
    minute = lambda x, k: F.regexp_extract(x, r"(\d{1,2}):(\d{2})\s*[-~〜–]\s*(\d{1,2}):(\d{2})", k).cast("int")
    return F.transform(found, lambda x: _range(minute(x, 1) * 60 + minute(x, 2), minute(x, 3) * 60 + minute(x, 4)))


def contains_range(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    """Whether hours lie within others, where ends at or before starts are on the next day."""
    oe = F.when(outer_end <= outer_start, outer_end + 1440).otherwise(outer_end)
    e = F.when(end <= start, end + 1440).otherwise(end)
    return ((start >= outer_start) & (e <= oe)) | ((start + 1440 >= outer_start) & (e + 1440 <= oe))


def with_spill(today: Column, yesterday: Column, minute: Column) -> Column:
    """Point test in which a night's hours belong to the next day, unlike :func:`segments`."""
    inside = lambda r: F.when(r["start"] < r["end"], (r["start"] <= minute) & (minute < r["end"])).otherwise(r["start"] <= minute)
    return F.exists(today, inside) | F.exists(yesterday, lambda r: (r["end"] <= r["start"]) & (minute < r["end"]))


def without_ban(opens: Column, ban_start: Column, ban_end: Column) -> Column:
    """Opening ranges without a daily ban (I09): a ban that ends before a range opens is that of the next day, 24 hours on, and a ban that covers the
    first opening leaves one range from the first allowed minute to the last, across breaks but never across the ban."""
    end = F.when(ban_end <= ban_start, ban_end + 1440).otherwise(ban_end)

    def allowed(r: Column) -> Column:
        shift = F.when(end <= r["start"], 1440).otherwise(0)
        a, b = ban_start + shift, end + shift
        parts = F.array(_range(r["start"], F.least(r["end"], a)), _range(F.greatest(r["start"], b), r["end"]))
        return F.filter(parts, lambda x: x["start"] < x["end"]).cast(RANGES)

    left = F.flatten(F.transform(opens.cast(RANGES), allowed))
    covers_first = ban_start <= F.get(opens, F.lit(0))["start"]
    return F.when((F.size(left) > 0) & covers_first, F.array(_range(F.element_at(left, 1)["start"], F.element_at(left, -1)["end"]))).otherwise(left).cast(RANGES)


def smoking_now(open_now: Column, non_smoking: Column, restricted: Column, text: Column, weekday: str, holiday: Column, minute: Column) -> Column:
    """Whether smoking is allowed now. Closed or known non-smoking is no; without hours, unless a restriction is noted; a ban on the
    weekday holds on holidays too; else the line of the holiday or weekday, or a text without days, has a range that holds the minute."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    banned = F.exists(lines, lambda x: F.trim(x).rlike(rf"^{weekday}\s+(?:喫煙不可|終日禁煙)$"))
    label = F.when(holiday, F.lit("祝日")).otherwise(F.lit(weekday))
    own = F.get(F.filter(lines, lambda x: x.startswith(F.concat(label, F.lit(" ")))), F.lit(0))
    line = F.coalesce(own, F.when(~text.rlike("^[月火水木金土日祝]"), text))
    ranges = F.transform(text_ranges(F.coalesce(line, F.lit("")), ""), lambda r: r)
    inside = F.exists(ranges, lambda r: F.when(r["start"] < r["end"], (r["start"] <= minute) & (minute < r["end"])).otherwise((r["start"] <= minute) | (minute < r["end"])))
    return (
        F.when(~open_now | non_smoking, False)
        .when(text.isNull() | (F.trim(text) == ""), ~restricted)
        .when(banned, False)
        .when(line.isNull() | line.rlike("喫煙不可|未設定|終日禁煙"), False)
        .otherwise(F.coalesce(inside, F.lit(False)))
    )
