"""Queries keep every row of their tables, whatever its id."""

import unicodedata
from datetime import datetime

import pytest

from placeworks.plans import QUERIES


@pytest.fixture(scope="module")
def odd_ids(spark, tmp_path_factory):
    """Tables whose ids no subset by 2, 7, 10 or 200 holds."""
    folder = str(tmp_path_factory.mktemp("odd_ids"))
    tables = {
        "part": ([(1, "zebra crossing", 3), (2, "my zebra", 4), (3, "zebra crossing", 5), (4, "red lamp", 5)], "p_partkey long, p_name string, p_size int"),
        "lineitem": ([(1, 5.0, "R"), (2, 2.0, "N"), (4, 1.0, "N")], "l_partkey long, l_quantity double, l_returnflag string"),
        "orders": ([(1, 11), (3, 11), (5, 13), (8, 13), (12, 15)], "o_orderkey long, o_custkey long"),
        "events": ([(200 + k, datetime(2024, 1, 1 + k % 7, k % 24, k % 60), k, "view", 1.0, '{"k": 1}') for k in range(300)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_names_and_articles(spark, odd_ids):
    assert {r["query"] for r in QUERIES["j10_any_name_in_query"](spark, odd_ids).collect()} == {"zebra crossing", "my zebra", "red lamp"}
    got = {r["query"]: (r["article"], r["score"]) for r in QUERIES["c21_any_article_relevance"](spark, odd_ids).collect()}
    assert got == {"zebra crossing": (1, 10), "my zebra": (2, 10), "red lamp": (4, 10)}


def windows():
    """(shop, weekday, opens, closes) of the orders above, by the rules of I01."""
    for key, shop in ((1, 11), (3, 11), (5, 13), (8, 13), (12, 15)):
        a, b = key * 37 % 1441, key * 53 % 1441
        for s, e in [(a, b)] if a < b else [(0, b), (a, 1440)]:
            yield shop, key % 7, s, e


def test_hours_and_events(spark, odd_ids):
    got = {(r["shop_id"], r["weekday"]): r["is_open"] for r in QUERIES["i05_any_open_at_ten"](spark, odd_ids).collect()}
    want = {}
    for shop, day, s, e in windows():
        want[shop, day] = want.get((shop, day), False) or s <= 600 < e
    assert got == want
    got = {r["event_id"]: r["open_windows"] for r in QUERIES["j08_open_windows"](spark, odd_ids).collect()}
    instants = {200 + k: ((k % 7 + 1) % 7, k % 24 * 60 + k % 60) for k in range(300)}  # 1 January 2024 was a Monday
    assert got == {i: sum(d == day and s <= m < e for _, d, s, e in windows()) for i, (day, m) in instants.items()}
    assert max(got.values()) > 0


def test_nfkc_of_whole_texts(spark, sf_dir):
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["text"] for r in QUERIES["t01_nfkc"](spark, sf_dir).collect()}
    assert max(map(len, source.values())) > 200
    assert got == {k: unicodedata.normalize("NFKC", x) for k, x in source.items()}
