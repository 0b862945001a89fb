"""Vectors for extraction and classes."""

from pyspark.sql import functions as F

from placeworks.functions import classify, extract
from placeworks.plans import QUERIES

LABELS = {"name": "店名", "address": "住所", "phone": "電話番号", "hours": "営業時間", "closed": "定休日", "budget": "予算"}
TEXT = """店名\t酒場　一番
住所
大阪府大阪市北区梅田1-2-3
地図を見る
電話番号：06-1234-5678
営業時間
月～木・土 17:00～翌2:00（L.O. 1:30）
日 11:00～15:00、17:00～25:00
定休日 第2火曜日、金
予算
￥3,000～￥3,999"""


def first(spark, column, text=TEXT):
    return spark.createDataFrame([(text,)], "s string").select(column.alias("x")).first()["x"]


def test_record(spark):
    r = first(spark, extract.record(F.col("s"), LABELS))
    assert (r["name"], r["address"], r["phone"]) == ("酒場 一番", "大阪府大阪市北区梅田1-2-3", "06-1234-5678")
    hours = {h["day"]: [tuple(x) for x in h["ranges"]] for h in r["hours"]}
    assert hours == {**{d: [(1020, 1560)] for d in (1, 2, 3, 4, 6)}, 0: [(660, 900), (1020, 1500)]}
    assert r["last_order"] == 90 and sorted(r["closed"]) == [2, 5]
    assert tuple(r["budget"]) == (3000, 3999)


def test_hours_without_days_hold_for_all(spark):
    assert {h["day"] for h in first(spark, extract.hours_by_day(F.col("s")), "10:00-19:00")} == set(range(7))
    assert first(spark, extract.hours_by_day(F.col("s")), "closed") == []


def test_rules(spark):
    rules = [("none", "飲み放題なし"), ("all", "飲み放題")]
    assert first(spark, extract.classes(F.col("s"), rules, "?"), "飲み放題なし") == "none"
    assert first(spark, extract.tags(F.col("s"), [("counter", "カウンター"), ("sofa", "ソファ"), ("table", "テーブル")]), "テーブル、カウンター") == ["counter", "table"]
    assert first(spark, classify.code(F.col("s"), {"all": 1, "1": 1}), " ALL ") == 1
    g = first(spark, classify.genre(F.col("s"), {"カフェ": "cafe"}, {"呑み屋": "pub"}, ["cafe", "pub"], "other"), "カフェ・喫茶")
    assert tuple(g) == ("cafe", None)
    assert first(spark, classify.area(F.col("s"), F.col("s"), [("umeda", "梅田"), ("namba", "難波")]), "東 梅田 駅") == "umeda"


def test_every_query_is_named_by_its_operator():
    import re

    assert all(re.match(r"^[a-z]\d\d[a-z]?_", name) for name in QUERIES)


def test_entry_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 200)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120).stdout.strip() == "True"
