"""Strict files, bulk inserts and levels of supply."""

import pytest
from pyspark.sql import functions as F

from placeworks.operators.supply import cube_of, with_level
from placeworks.sources import append_once, appended, strict_csv_files


def read(spark, *contents, **options):
    files = spark.createDataFrame([(f"f{k}", c) for k, c in enumerate(contents)], "path string, content binary")
    return sorted(tuple(r) for r in strict_csv_files(files, ["店名", "n"], **options).collect())


def sj(text):
    return bytearray(text.encode("cp932"))


def test_records_of_strict_files(spark):
    """Quoted line ends, bad lines that do not spoil others, blank lines, columns in another order or absent, several files at once."""
    rows = read(spark, sj('n,店名\r\n1,"甲\r\n乙"\r\n\r\n2,丙\r\n'), sj('店名,n\nx"y"z,1\n"a"b,2\n丁,3,4\n戊,5\n'), sj("店名\nx\n"), required=["店名"])
    assert rows == [("f0", 2, "甲\n乙", "1", True), ("f0", 5, "丙", "2", True), ("f1", 2, 'x"y"z', "1", True), ("f1", 3, None, None, False), ("f1", 4, None, None, False), ("f1", 5, "戊", "5", True), ("f2", 2, "x", None, True)]
    assert read(spark, sj("店名,n\n")) == []


@pytest.mark.parametrize(
    ("content", "options", "why"),
    [
        (bytearray(b"n\n\x81\n"), {}, "line 2 cannot be decoded"),
        (bytearray(b"n\na\0b\n"), {}, "line 2 has a NUL"),
        (sj('店名,n\n"x,1\n'), {}, "never closed"),
        (sj("店名,m\nx,1\n"), {}, "lacks"),
        (sj("店名,n,n\nx,1,2\n"), {}, "repeats"),
        (sj("店名,n\nx,1\ny,2\n"), {"max_rows": 1}, "more than 1 rows"),
        (sj("店名,n\nx,1\n"), {"max_bytes": 4}, "more than 4 bytes"),
        (None, {}, "no header"),
    ],
)
def test_files_that_stop_the_read(spark, content, options, why):
    with pytest.raises(Exception, match=why):
        read(spark, content, **options)


def test_appended_once(spark, tmp_path):
    rows, path = spark.range(5).withColumn("x", F.lit("a")), f"file://{tmp_path}/t"
    assert append_once(rows, path, "one") and not append_once(rows.withColumn("x", F.lit("b")), path, "one")
    rows.write.parquet(f"{path}/rows/batch=two")  # a run that broke after staging
    assert appended(spark, path).count() == 5
    assert append_once(rows.filter("id < 2"), path, "two")
    assert sorted((r["batch"], r["id"], r["x"]) for r in appended(spark, path).collect()) == [("one", k, "a") for k in range(5)] + [("two", k, "a") for k in range(2)]


def test_levels_of_supply(spark):
    shops = spark.createDataFrame([("a", "x", 1), ("a", "y", None), ("b", "x", 1), (None, "x", 1), ("a", "x", 1), ("*", "x", 1)], "area string, genre string, ok int")
    wanted = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), (None, None), ("c", "x"), ("*", None)], "area string, genre string")
    cube = cube_of(shops, ["area", "genre"], shops=F.count("*"), ok=F.count("ok"))
    got = {(r["area"], r["genre"]): (r["shops"], r["ok"]) for r in with_level(wanted, cube, ["area", "genre"], ["shops", "ok"]).collect()}
    assert got == {("a", "x"): (2, 2), ("a", None): (3, 2), (None, "x"): (5, 5), (None, None): (6, 5), ("c", "x"): (0, 0), ("*", None): (1, 1)}
