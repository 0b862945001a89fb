"""Pasted pages as typed records (X01-X09, A21): pages are written from the customer table, so what they say is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeworks.functions import pasted as X
from placeworks.functions.extract import field
from placeworks.plans.registry import query
from placeworks.plans.roles import Tables

#: (smoking field, area, type) of pages.
SMOKING = [
    ("分煙（加熱式たばこのみ可）", "all_smoking", "electronic_only"),
    ("テラス席のみ喫煙可", "all_smoking", "both_ok"),
    ("2階は喫煙可能", "all_smoking", "both_ok"),
    ("店外に灰皿あり", "separated", "both_ok"),
    ("入口横のベンチで喫煙", "separated", "unknown"),
    ("喫煙専用室あり", "separated", "both_ok"),
    ("昼は禁煙、夜は喫煙可", "all_smoking", "both_ok"),
    ("分煙 禁煙席あり", "all_smoking", "both_ok"),
    ("分煙", "unknown", "unknown"),
    ("全席喫煙可", "all_smoking", "both_ok"),
    ("紙巻きたばこのみ喫煙可", "all_smoking", "paper_only"),
    ("紙たばこは禁止、加熱式は喫煙可", "all_smoking", "electronic_only"),
    ("全席禁煙", "unknown", "unknown"),
    ("喫煙不可 21時以降は喫煙可", "all_smoking", "both_ok"),
    ("", None, "unknown"),
]
ROOMS = [("半個室あり", "semi_private_room"), ("有", "full_private_room"), ("無", "no_private_room"), ("応相談", "unknown")]
HOURS = [
    ("月・火・水\n11:00～14:00\n17:00～翌1:00\n（L.O. 23:30）\n木\n定休日\n■ 定休日\n木曜日", "monday", "11:00", "25:00", "14:00", "17:00", True),
    ("11:30-22:00（L.O.料理21:00）\n※年末年始は休業", "sunday", "11:30", "22:00", None, None, None),
    ("[土・日・祝日]\n12:00 - 23:00\n不定休", "sunday", "12:00", "23:00", None, None, None),
]


def _pick(k, values):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values) + 1).cast("int"))


def _case(values, key="c_custkey") -> str:
    quoted = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def _pages(t: Tables):
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("店名\t"), "c_name", F.lit("\nジャンル\t居酒屋、バー\n予約・お問い合わせ\n06-1234-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("\n住所\n大阪府大阪市北区"), k.cast("string"), F.lit("\n地図を見る\n営業時間\n"), _pick(k, [h[0] for h in HOURS]),
        F.lit("\n予算\n￥"), (k % 9 + 1).cast("string"), F.lit(",000～￥9,999\n個室\t"), _pick(k, [r[0] for r in ROOMS]), F.lit("\n禁煙・喫煙\t"), _pick(k, [s[0] for s in SMOKING]), F.lit("\n空間・設備\tカウンター席あり"), F.when(k % 2 == 0, "、ソファ席あり").otherwise(""), F.lit("\nコース\t"), F.when(k % 5 == 0, "飲み放題").otherwise("料理のみ"),
    )
    return t.base("customer").select(k, text.alias("page"))


@query(f"""SELECT c_custkey, c_name AS name, '06-1234-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone, '大阪府大阪市北区' || CAST(c_custkey AS VARCHAR) AS address, CAST(c_custkey % 9 + 1 AS VARCHAR) || ',000～9,999' AS budget_range,
{_case([r[1] for r in ROOMS])} AS private_room_type, CASE WHEN c_custkey % 2 = 0 THEN ['counter', 'sofa'] ELSE ['counter'] END || CASE WHEN {_case([s[0] for s in SMOKING])} LIKE '%テラス%' THEN ['terrace'] ELSE [] END AS seat_type_tags, CASE WHEN c_custkey % 5 = 0 THEN 'has_all_you_can_drink' ELSE 'unknown' END AS all_you_can_drink_type FROM customer""")
def x01_parsed_pages(t: Tables):
    p = X.parsed(_pages(t), "page", "p")
    return p.select("c_custkey", *[f"p.{c}" for c in ("name", "phone", "address", "budget_range", "private_room_type", "seat_type_tags", "all_you_can_drink_type")])


@query(f"SELECT c_custkey, nullif({_case([s[0] for s in SMOKING])}, '') AS smoking, '居酒屋、バー' AS genre FROM customer")
def x02_labelled_fields(t: Tables):
    of = lambda label: field(F.col("page"), label, X.LABELS)
    return _pages(t).select("c_custkey", of("禁煙・喫煙").alias("smoking"), of("ジャンル").alias("genre"))


@query(f"""SELECT c_custkey, {_case([h[1] for h in HOURS])} AS day, {_case([h[2] for h in HOURS])} AS open, {_case([h[3] for h in HOURS])} AS close, {_case([h[4] for h in HOURS])} AS break_start, {_case([h[5] for h in HOURS])} AS break_end, {_case([h[6] for h in HOURS])} AS thursday_closed,
CAST({_case(["4", "7", "2"])} AS INTEGER) AS days FROM customer""")
def x03_hours_by_day(t: Tables):
    """The hours of one named day, and how many days have any; a close after midnight counts on past 24."""
    s = _pages(t).select("c_custkey", X.schedule_by_day(field(F.col("page"), "営業時間", X.LABELS)).alias("s"), _pick(F.col("c_custkey"), [h[1] for h in HOURS]).alias("day"))
    s = s.withColumn("d", F.element_at("s", F.col("day")))
    thursday = F.when(F.col("c_custkey") % 3 == 0, F.element_at("s", F.lit("thursday"))["closed"])
    return s.select("c_custkey", "day", "d.open", "d.close", "d.break_start", "d.break_end", thursday.alias("thursday_closed"), F.size("s").alias("days"))


_RANGES = [("昼は禁煙、夜は喫煙可", [(1020, 1500)]), ("14:00～18:00は禁煙", [(660, 840), (1080, 1500)]), ("21時以降喫煙可", [(1260, 1500)]), ("18:30まで禁煙", [(1110, 1500)]), ("全席禁煙", []), ("喫煙可", [(660, 870), (1020, 1500)])]


@query("SELECT c_custkey, CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN [" + ", ".join(f"'{a}-{b}'" for a, b in r) + "]" for i, (_, r) in enumerate(_RANGES)) + " END AS ranges FROM customer")
def x05_smoking_hours(t: Tables):
    """Opening ranges 11:00-14:30 and 17:00-25:00 by what the smoking field says."""
    opens = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((660, 870), (1020, 1500))])
    ranges = X.smoking_ranges(_pick(F.col("c_custkey"), [r[0] for r in _RANGES]), opens)
    return t.base("customer").select("c_custkey", F.transform(ranges, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))).alias("ranges"))


_CONDITIONS = [("分煙（加熱式たばこのみ可）店外で紙たばこ喫煙可", ["all_smoking electronic_only", "separated both_ok"]), ("席は加熱式たばこ喫煙可、紙たばこのみ喫煙所", ["all_smoking electronic_only", "separated paper_only"]), ("2階席のみ喫煙可", ["all_smoking both_ok"]), ("店外に灰皿あり", ["separated both_ok"])]


@query("SELECT c_custkey, CASE c_custkey % 4 " + " ".join(f"WHEN {i} THEN {c!r}" for i, (_, c) in enumerate(_CONDITIONS)) + " END AS conditions FROM customer")
def x07_smoking_conditions(t: Tables):
    raw = _pick(F.col("c_custkey"), [c[0] for c in _CONDITIONS])
    found = X.smoking_conditions(raw, F.lit("").cast("string"))
    return t.base("customer").select("c_custkey", F.transform(found, lambda c: F.concat_ws(" ", c["area"], c["type"])).alias("conditions"))


@query(f"SELECT c_custkey, {_case([s[1] for s in SMOKING])} AS area, {_case([s[2] for s in SMOKING])} AS type FROM customer")
def x08_flat_classes(t: Tables):
    raw = _pick(F.col("c_custkey"), [s[0] for s in SMOKING])
    return t.base("customer").select("c_custkey", X.smoking_area(raw, F.lit("")).alias("area"), X.smoking_type(raw, F.lit("")).alias("type"))


@query(f"SELECT c_custkey, {_case(['木曜日', None, '不定休'])} AS closed_days, {_case(['23:30', '料理21:00', None])} AS last_order, {_case([None, '※年末年始は休業', '不定休'])} AS note FROM customer")
def x09_notes(t: Tables):
    p = _pages(t).withColumn("hours", field(F.col("page"), "営業時間", X.LABELS))
    return p.select("c_custkey", X.closed_days_text(F.col("page"), F.col("hours")).alias("closed_days"), X.last_order_text(F.col("hours")).alias("last_order"), X.special_note(F.col("hours")).alias("note"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ['seats both_ok'] WHEN 1 THEN ['seats paper_only', 'outside electronic_only'] WHEN 2 THEN ['seats both_ok', 'outside paper_only'] ELSE ['seats electronic_only'] END AS conditions FROM customer""")
def a21_merged_types(t: Tables):
    one = lambda area, kind: F.struct(F.lit(area).alias("area"), F.lit(kind).alias("type"))
    k = F.col("c_custkey") % 4
    rows = (
        F.when(k == 0, F.array(one("seats", "paper_only"), one("seats", "electronic_only")))
        .when(k == 1, F.array(one("seats", "paper_only"), one("outside", "electronic_only")))
        .when(k == 2, F.array(one("seats", "paper_only"), one("outside", "paper_only"), one("seats", "both_ok")))
        .otherwise(F.array(one("seats", "electronic_only"), one("seats", "electronic_only")))
    )
    return t.base("customer").select("c_custkey", F.transform(X.merged_types(rows), lambda c: F.concat_ws(" ", c["area"], c["type"])).alias("conditions"))
