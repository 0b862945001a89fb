"""Arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of a weekly schedule and the fields of a day.
DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
SCHEDULE = "map<string,struct<closed:boolean,open:string,close:string,break_enabled:boolean,break_start:string,break_end:string>>"


def lookup(table: dict, key: Column, default) -> Column:
    """Value of a small fixed table."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key], F.lit(default))


def clean_list(c: Column, allowed: list[str] | None = None) -> Column:
    """Trimmed, without blanks, only allowed values, distinct and in order of first appearance."""
    items = F.filter(F.transform(c, lambda x: F.trim(x.cast("string"))), lambda x: x != "")
    if allowed is not None:
        items = F.filter(items, lambda x: x.isin(*allowed))
    return F.array_distinct(items)


def schedule(text: Column) -> Column:
    """A JSON schedule: closed days keep only that, days without both ends go, a break needs both of its ends."""
    days = F.from_json(text, SCHEDULE)
    ok = F.map_filter(days, lambda _, v: F.coalesce(v["closed"], F.lit(False)) | (v["open"].isNotNull() & v["close"].isNotNull()))

    def one(_, v):
        closed = F.coalesce(v["closed"], F.lit(False))
        rests = F.coalesce(v["break_enabled"], F.lit(False)) & v["break_start"].isNotNull() & v["break_end"].isNotNull() & ~closed
        kept = lambda name, when: F.when(when, v[name]).alias(name)
        return F.struct(closed.alias("closed"), kept("open", ~closed), kept("close", ~closed), rests.alias("break_enabled"), kept("break_start", rests), kept("break_end", rests))

    return F.transform_values(ok, one)


def schedule_of_text(c: Column) -> Column:
    """Map of day to 'open-close' from lines like 'monday: 09:00-18:00' (N04)."""
    lines = F.filter(F.split(F.lower(c), "\n"), lambda x: x.rlike(r"^\s*[a-z]+\s*:\s*\d{1,2}:\d{2}\s*-\s*\d{1,2}:\d{2}"))
    part = lambda x, k: F.regexp_extract(x, r"^\s*([a-z]+)\s*:\s*(\d{1,2}:\d{2})\s*-\s*(\d{1,2}:\d{2})", k)
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(part(x, 1), F.concat_ws("-", part(x, 2), part(x, 3)))))


def truthy(c: Column) -> Column:
    """N06."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "on"), F.lit(False))


def day_range(first: Column, last: Column) -> Column:
    """Days from first to last, over the end of the week if need be."""
    n = F.pmod(last - first, F.lit(7))
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.pmod(first + k, F.lit(7)))


def only_keys(c: Column, keys: list[str]) -> Column:
    """N09."""
    return F.map_filter(c, lambda k, _: k.isin(*keys))


def any_of(c: Column, values: list) -> Column:
    return F.exists(c, lambda x: x.isin(*values))


def all_of(c: Column, values: list) -> Column:
    return F.forall(c, lambda x: x.isin(*values))


def dig(json: Column, *path: str) -> Column:
    """Scalar at a path of a JSON string."""
    return F.get_json_object(json, "$." + ".".join(path))
