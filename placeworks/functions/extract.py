"""Typed values from pasted text: labelled fields, opening hours by day, flat classes.

Rules are parameters (tables of label and pattern), not part of the functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeworks.functions.hours import RANGES
from placeworks.functions.text import SPACES, first_rule, half_width, phone, presence

#: Weekdays as they are written, Sunday first.
DAY_NAMES = "日月火水木金土"


def field(text: Column, label: str, labels: list[str], continued: bool = False) -> Column:
    """Value behind a label on its line (tab, colon or spaces between), or on the lines below it up to the next known label.

    Behind a tab the value ends with the line, unless it is ``continued`` on lines below.
    """
    every = "|".join(re.escape(x) for x in labels)
    gap = r"[ \t　:：]"
    below = rf"(.*(?:\n(?!(?:{every})(?:{gap}|$)).*)*)"
    block = F.regexp_extract(text, rf"(?m)^{re.escape(label)}(?:{gap}+|$)\n?{below}", 1)
    tabbed = rf"(?m)^{re.escape(label)}\t"
    same = F.regexp_extract(text, tabbed + (below if continued else "(.*)$"), 1)
    return presence(F.trim(F.when(text.rlike(tabbed), same).otherwise(block)))


def fields(text: Column, labels: list[str]) -> Column:
    """All labelled fields as a struct."""
    return F.struct(*[field(text, x, labels).alias(x) for x in labels])


def days_of(expression: Column) -> Column:
    """Weekdays (Sunday 0) that an expression like 月～木・土 names, in order and distinct."""
    e = half_width(expression)
    pattern = F.lit(f"([{DAY_NAMES}])(?:曜日?)?(?:[~～〜–-]([{DAY_NAMES}]))?")
    first, last = (F.regexp_extract_all(e, pattern, F.lit(k)) for k in (1, 2))
    number = lambda d: F.instr(F.lit(DAY_NAMES), d) - 1

    def run(a: Column, b: Column) -> Column:
        n = F.when(b == "", 0).otherwise(F.pmod(number(b) - number(a), F.lit(7)))
        return F.transform(F.sequence(F.lit(0), n), lambda k: F.pmod(number(a) + k, F.lit(7)))

    return F.array_distinct(F.flatten(F.zip_with(first, last, run)))


def ranges_of(line: Column) -> Column:
    """Hours in a line as ranges of minutes; 翌 in front of an end and ends past 24:00 are on the next day."""
    s = half_width(line)
    pattern = F.lit(r"(\d{1,2}):(\d{2})\s*[~～〜–-]\s*(翌?)\s*(\d{1,2}):(\d{2})")
    part = lambda k: F.regexp_extract_all(s, pattern, F.lit(k))
    rows = F.arrays_zip(part(1).alias("h"), part(2).alias("m"), part(3).alias("n"), part(4).alias("i"), part(5).alias("j"))
    minute = lambda h, m: h.cast("int") * 60 + m.cast("int")
    end = lambda r: minute(r["i"], r["j"]) + F.when((r["n"] != "") & (r["i"].cast("int") < 24), 1440).otherwise(0)
    return F.transform(rows, lambda r: F.struct(minute(r["h"], r["m"]).alias("start"), end(r).cast("int").alias("end"))).cast(RANGES)


def hours_by_day(text: Column) -> Column:
    """Rows (day, ranges) of an opening-hours text: lines that name days, or hold for all if they name none."""
    lines = F.filter(F.split(text, r"[\n/／]"), lambda x: x.rlike(r"\d{1,2}[:：]\d{2}"))
    head = lambda x: F.regexp_extract(x, rf"^[\s　]*([{DAY_NAMES}祝曜日・、,~～〜–\-\[\]［］]+)", 1)
    found = lambda x: days_of(head(x))
    every = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: d.cast("int"))
    rows = F.transform(lines, lambda x: F.struct(F.when(F.size(found(x)) > 0, found(x).cast("array<int>")).otherwise(every).alias("days"), ranges_of(x).alias("ranges")))
    return F.flatten(F.transform(rows, lambda r: F.transform(r["days"], lambda d: F.struct(d.alias("day"), r["ranges"].alias("ranges")))))


def closed_days(text: Column) -> Column:
    """Weekdays of a closing note."""
    return days_of(F.regexp_replace(text, r"第[0-9０-９一二三四五・、,]+", ""))


def tags(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of all rules whose pattern matches, in the rules' order."""
    return F.filter(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(label)) for label, p in rules]), lambda x: x.isNotNull())


def classes(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The first rule that matches (X05-X08): order is the meaning."""
    return first_rule(half_width(text), rules, default)


def budget(text: Column) -> Column:
    """Lower and upper amount of a price range."""
    s = F.regexp_replace(half_width(text), r"[,，]", "")
    pattern = r"[¥￥]?(\d{3,6})円?\s*[~～〜–-]\s*[¥￥]?(\d{3,6})?"
    return F.struct(F.regexp_extract(s, pattern, 1).try_cast("int").alias("low"), F.regexp_extract(s, pattern, 2).try_cast("int").alias("high"))


def last_order(text: Column) -> Column:
    """Minute of the day of the last order."""
    s = half_width(text)
    hour, minute = (F.regexp_extract(s, r"(?:L\.?O\.?|ラストオーダー)\D{0,4}(\d{1,2}):(\d{2})", k).try_cast("int") for k in (1, 2))
    return hour * 60 + minute


def record(text: Column, labels: dict[str, str]) -> Column:
    """A whole pasted record (X01): ``labels`` maps roles (name, address, phone, hours, closed, budget) to the labels in the text."""
    known = list(labels.values())
    of = lambda role: field(text, labels[role], known)
    return F.struct(
        F.regexp_replace(of("name"), SPACES, " ").alias("name"),
        F.split_part(of("address"), F.lit("\n"), F.lit(1)).alias("address"),
        phone(of("phone")).alias("phone"),
        hours_by_day(of("hours")).alias("hours"),
        last_order(of("hours")).alias("last_order"),
        closed_days(of("closed")).alias("closed"),
        budget(of("budget")).alias("budget"),
    )
