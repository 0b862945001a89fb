"""Pasted pages read in Arrow batches: labelled fields, and what clauses say about smoking.

A page is read line by line with state, which columns can only express by folding every line through every rule; here a batch of pages
is one call and each page is read once. The rules are those of ``functions/clauses.py``. Rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from placeworks.functions import clauses

SMOKING = "struct<hours_text:string,hours_by_day:map<string,string>,conditions:array<struct<area:string,type:string>>,schedules:map<string,map<string,string>>>"
_TEXT_MAP = pa.map_(pa.string(), pa.string())
_SMOKING = pa.struct([("hours_text", pa.string()), ("hours_by_day", _TEXT_MAP), ("conditions", pa.list_(pa.struct([("area", pa.string()), ("type", pa.string())]))), ("schedules", pa.map_(pa.string(), _TEXT_MAP))])


def _said(raw: str | None, hours: str | None) -> dict:
    found = clauses.smoking(raw or "", hours or "")
    return found | {"hours_by_day": list(found["hours_by_day"].items()), "schedules": [(k, list(v.items())) for k, v in found["schedules"].items()]}


def smoking(raw: Column, hours: Column) -> Column:
    """What a smoking field says of a shop with these hours (X05-X07): hours as text, null if none follow, and by day; one or two conditions; schedules
    of conditions that have hours of their own. Null fields say nothing."""

    def read(raw: pa.Array, hours: pa.Array) -> pa.Array:
        return pa.array([_said(r, h) for r, h in zip(raw.to_pylist(), hours.to_pylist())], _SMOKING)

    return F.arrow_udf(read, SMOKING)(raw, hours)


def fields(page: Column, labels: list[str], continued: tuple[str, ...] = ()) -> Column:
    """Labelled fields of a page as map (X02): the value stands behind a label's tab, colon or spaces, or on the lines below up to the next label.
    Behind a tab it ends with the line, unless the label is ``continued``. The first of repeated labels counts; blank fields are not in the map."""
    head = re.compile("^(" + "|".join(map(re.escape, sorted(labels, key=len, reverse=True))) + ")(?:([ \\t　:：]+)|$)")

    def of(text: str | None) -> list[tuple[str, str]]:
        found: dict[str, list[str]] = {}
        now: list[str] | None = None
        for line in (text or "").split("\n"):
            m = head.match(line)
            if m:
                rest = line[m.end() :]
                now = [rest] if rest else []
                if m[1] in found:
                    now = None
                else:
                    found[m[1]] = now
                    if "\t" in (m[2] or "")[:1] and m[1] not in continued:
                        now = None
            elif now is not None:
                now.append(line)
        values = {k: "\n".join(v).strip() for k, v in found.items()}
        return [(k, v) for k, v in values.items() if v]

    def read(page: pa.Array) -> pa.Array:
        return pa.array([of(x) for x in page.to_pylist()], _TEXT_MAP)

    return F.arrow_udf(read, "map<string,string>")(page)


def opening_hours_text(raw: Column, by_day: Column) -> Column:
    """Hours as text by day (X04): each service with its last order, and with the smoking hours ``by_day`` that lie in it."""

    def one(raw: str | None, days: list[tuple[str, str]] | None) -> str | None:
        _, closed, rows = clauses.opening(raw or "")
        allowed = {d: clauses.ranges(v) for d, v in days or []}
        found: dict[str, list[tuple[str, str]]] = {}
        for names, service, last in rows:
            for day in names:
                inside = [x for x in allowed.get(day, []) if clauses.lies_in(x, service)]
                text = f"{service.opens}-{service.closes}" + (f"（L.O. {last}）" if last else "") + (f"（喫煙可：{', '.join(f'{x.opens}-{x.closes}' for x in inside)}）" if inside else "")
                if text not in (t for _, t in found.setdefault(day, [])):
                    found[day].append((service.opens, text))
        return "\n".join(f"{label} {', '.join(t for _, t in sorted(found[d], key=lambda x: x[0]))}" for d, label in clauses.DAYS.items() if d in found) or None

    def read(raw: pa.Array, by_day: pa.Array) -> pa.Array:
        return pa.array([one(r, d) for r, d in zip(raw.to_pylist(), by_day.to_pylist())], pa.string())

    return F.arrow_udf(read, "string")(raw, by_day)


SCHEDULE = "map<string,struct<closed:boolean,open:string,close:string,break_enabled:boolean,break_start:string,break_end:string>>"
_SCHEDULE = pa.map_(pa.string(), pa.struct([("closed", pa.bool_()), ("open", pa.string()), ("close", pa.string()), ("break_enabled", pa.bool_()), ("break_start", pa.string()), ("break_end", pa.string())]))


def schedule(raw: Column) -> Column:
    """Opening, closing and break by day (X03): of a day's services the first two make a break, unless one ends where the other begins; days that are named as
    closed are there without times."""

    def one(raw: str | None) -> list[tuple[str, dict]]:
        week, closed, _ = clauses.opening(raw or "")
        out = []
        for day in clauses.DAYS:
            services = week.get(day, [])[:2]
            rests = len(services) == 2 and services[0].closes != services[1].opens
            if services or day in closed:
                times = {"open": services[0].opens, "close": services[-1].closes, "break_enabled": rests} if services else {"break_enabled": False}
                out.append((day, {"closed": not services, **times, **({"break_start": services[0].closes, "break_end": services[1].opens} if rests else {})}))
        return out

    def read(raw: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in raw.to_pylist()], _SCHEDULE)

    return F.arrow_udf(read, SCHEDULE)(raw)
