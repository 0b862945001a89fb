"""Pasted pages in Arrow batches: fields, schedules, hours as text, and whole pages."""

import pytest
from pyspark.sql import functions as F

from placeworks.functions import extract
from placeworks.functions import pasted as X
from placeworks.operators import pasted
from placeworks.plans.pages import _pages
from placeworks.plans.roles import Tables


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


PAGE = "店名\t酒場\nジャンル\n居酒屋、バー\n\n住所 大阪府\n禁煙・喫煙\t分煙\n個室のみ禁煙\n予算\n￥1,000\n住所\n京都府\nコース\n  \nドリンク"


def test_fields_in_one_pass_are_those_of_the_pattern(spark):
    """The same values as by a pattern for each label, and odd pages."""
    got = one(spark, pasted.fields(F.col("s"), X.LABELS, ("禁煙・喫煙",)), s=PAGE)
    assert got == {"店名": "酒場", "ジャンル": "居酒屋、バー", "住所": "大阪府", "禁煙・喫煙": "分煙\n個室のみ禁煙", "予算": "￥1,000"}
    assert one(spark, pasted.fields(F.col("s"), X.LABELS), s=None) == one(spark, pasted.fields(F.col("s"), X.LABELS), s="no label") == {}
    pages = _pages(Tables(spark, "/root/testdata/sf0.001"))
    by_pattern = pages.select("page", *[extract.field(F.col("page"), x, X.LABELS, continued=x == "禁煙・喫煙").alias(f"f{k}") for k, x in enumerate(X.LABELS)]).distinct().collect()
    by_pass = {r["page"]: r["x"] for r in pages.select("page", X.fields_of(F.col("page")).alias("x")).collect()}
    for r in by_pattern[:40]:
        assert by_pass[r["page"]] == {x: r[f"f{k}"] for k, x in enumerate(X.LABELS) if r[f"f{k}"] is not None}


@pytest.mark.parametrize(
    ("hours", "day", "want"),
    [
        ("月・火\n11:00 - 14:00\n17:00 - 22:00", "monday", (False, "11:00", "22:00", True, "14:00", "17:00")),
        ("月・火\n11:00 - 14:00\n水\n定休日", "wednesday", (True, None, None, False, None, None)),
        ("11:00 - 23:00", "holiday", (False, "11:00", "23:00", False, None, None)),
        ("祝後日\n17:10 - 23:55", "post_holiday", (False, "17:10", "23:55", False, None, None)),
        ("■ 営業時間\nランチ／11：30～\nディナー／17:30～翌1:00", "monday", (False, "11:30", "25:00", False, None, None)),
        ("11:00 - 21:00\n■ 営業時間\nランチ 11：00～15：00\nディナー17：00～21：00", "monday", (False, "11:00", "21:00", True, "15:00", "17:00")),
    ],
)
def test_schedule(spark, hours, day, want):
    assert tuple(one(spark, pasted.schedule(F.col("s")), s=hours)[day]) == want


def test_schedules_of_odd_texts(spark):
    assert one(spark, pasted.schedule(F.col("s")), s=None) == one(spark, pasted.schedule(F.col("s")), s="年中無休") == {}
    plain = one(spark, pasted.schedule(F.col("s")), s="11:00 - 23:00")
    assert "pre_holiday" not in plain and len(plain) == 8


def test_hours_with_smoking_and_last_orders(spark):
    hours = "月\n17:00 - 23:30\nL.O. 23:00\n火・水\n11:30 - 15:00\nL.O. 14:30\n17:00 - 23:30\n土\n11:30 - 23:30"
    told = spark.createDataFrame([(hours, "全席喫煙可\nランチタイムは禁煙とさせていただきます。")], "h string, s string").withColumn("x", pasted.smoking(F.col("s"), F.col("h")))
    text = told.select(pasted.opening_hours_text(F.col("h"), F.col("x.hours_by_day"))).first()[0]
    assert text == "月 17:00-23:30（L.O. 23:00）（喫煙可：17:00-23:30）\n火 11:30-15:00（L.O. 14:30）, 17:00-23:30（喫煙可：17:00-23:30）\n水 11:30-15:00（L.O. 14:30）, 17:00-23:30（喫煙可：17:00-23:30）\n土 11:30-23:30（喫煙可：15:00-23:30）"
    assert told.select(pasted.opening_hours_text(F.lit(None).cast("string"), F.col("x.hours_by_day"))).first()[0] is None


@pytest.mark.parametrize(
    ("hours", "text", "want"),
    [
        ("08:00 - 20:00\nL.O. 19:30", "全席喫煙可\n8:00～14:00までカウンター席のみ禁煙", {"primary": {"mode": "business", "seat_location": "non_counter"}, "secondary": {"mode": "custom", "hours_text": "14:00-20:00", "seat_location": "counter"}}),
        ("月・火・水・木・金\n16:00 - 04:00\n土・日・祝日\n13:00 - 04:00", "全席喫煙可\n※加熱式タバコ限定（22時以降、紙タバコも喫煙可）", {"primary": {"mode": "business"}, "secondary": {"mode": "custom", "hours_text": "22:00-04:00"}}),
        ("月・火・木・金・土・日\n17:00 - 23:00\n水\n定休日", "分煙（加熱式たばこ限定）\n17時～加熱式タバコ 21時～紙タバコ喫煙可能となっておます。", {"primary": {"mode": "custom", "hours_text": "17:00-23:00"}, "secondary": {"mode": "custom", "hours_text": "21:00-23:00"}}),
        ("火・木・土\n11:00 - 16:00\n18:00 - 22:00\n水・金\n11:00 - 16:00", "分煙\nお昼はカウンターのみ喫煙可。夜は全面喫煙席", {"primary": {"mode": "business", "seat_location": "counter"}, "secondary": {"mode": "custom", "hours_text": "火 18:00 - 22:00\n水 喫煙不可\n木 18:00 - 22:00\n金 喫煙不可\n土 18:00 - 22:00", "seat_location": "non_counter"}}),
        ("月\n07:00 - 15:00\n17:30 - 21:00", "全席喫煙可\n11:00～12:30まで完全禁煙", {"primary": {"mode": "custom", "hours_text": "月 07:00 - 11:00, 12:30 - 15:00, 17:30 - 21:00"}}),
        ("月\n11:30 - 00:00", "全席喫煙可\n13:00までのランチタイムは全席禁煙。店外に灰皿有り。", {"primary": {"mode": "custom", "hours_text": "月 13:00 - 00:00"}, "secondary": {"mode": "business"}}),
        ("月\n17:00 - 05:00", "分煙\n※１階：禁煙、2階：喫煙可（紙たばこ可）／22時以降、全席にて喫煙可", {"primary": {"mode": "business"}}),
        ("月\n17:00 - 05:00", "分煙\n掘りごたつ席、カウンターは喫煙可能です", {"primary": {"seat_location": "counter_and_horigotatsu"}}),
        ("月\n17:00 - 05:00", "分煙\n室内は禁煙。テラス席の一部喫煙可。", {"primary": {"seat_location": "terrace"}}),
        ("月\n17:00 - 05:00", "分煙\nカウンター全席喫煙可", {"primary": {"seat_location": "counter"}}),
        ("月\n11:00 - 22:00", "全席喫煙可\n夜は喫煙可", {}),
    ],
)
def test_schedules_of_conditions(spark, hours, text, want):
    assert one(spark, pasted.smoking(F.col("s"), F.col("h")), s=text, h=hours)["schedules"] == want


def test_parsed_page(spark):
    page = "店名\n大一そば\nジャンル\n居酒屋、バー、その他\n営業時間\n月・水\n10:30 - 20:45\n火\n定休日\n禁煙・喫煙\n全席喫煙可\n※ランチ時（11:30~14:00）禁煙\n駐車場\n無"
    r = spark.createDataFrame([(page,), (None,), ("",)], "page string").transform(lambda d: X.parsed(d)).select("parsed.*").collect()
    assert (r[0]["name"], r[0]["genre_other"], r[0]["smoking_area"], r[0]["smoking_type"], r[0]["parking"]) == ("大一そば", "バー、その他", "all_smoking", "both_ok", "無")
    assert r[0]["smoking_hours_text"] == "月 10:30 - 11:30, 14:00 - 20:45\n水 10:30 - 11:30, 14:00 - 20:45"
    assert r[0]["opening_hours_text"] == "月 10:30-20:45（喫煙可：10:30-11:30, 14:00-20:45）\n水 10:30-20:45（喫煙可：10:30-11:30, 14:00-20:45）"
    assert r[0]["opening_hours"]["tuesday"]["closed"] and r[1]["name"] is None and r[2]["smoking_hours_text"] is None
