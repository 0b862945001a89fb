"""Vectors for functions that have no SQL form, and edge cases of those that have."""

import pytest
from pyspark.sql import functions as F

from placeworks.functions import arrays, geo, hours, scores, text, times
from placeworks.operators import linkage, merging, predicates, ranking, review, weekly
from placeworks.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def values(spark, rows, make):
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    return [r["x"] for r in df.select(make(F.col("s")).alias("x")).collect()]


def test_normalisation(spark):
    assert values(spark, ["Ｂａｒ　Ａ・Ｂ（本店）", None], text.duplicate_key) == ["barab本店", None]
    assert values(spark, ["ｶﾌｪ　Ａ"], text.linkage_name) == ["カフェa"]
    assert values(spark, ["", " 　", None, "a"], text.is_blank) == [True, True, True, False]
    assert values(spark, ["二十三", "十", "九", "百", "十一"], text.kanji_number) == [23, 10, 9, None, 11]
    assert values(spark, ["〒530-0001 大阪府大阪市北区梅田1", "京都府京都市中京区1"], text.municipality) == ["大阪市北区", "京都市中京区"]
    assert values(spark, ["大阪市北区梅田一丁目2番3号 ビル２Ｆ", "どこか"], lambda c: text.address_parts(c)["street"]) == ["大阪市北区梅田1-2-3", "どこか"]
    assert values(spark, ["B1F・2階", "x"], text.floors) == [["2", "b1"], []]


def test_similarity(spark):
    like = lambda a, b: one(spark, text.similarity(F.lit(a), F.lit(b)))
    assert like("abc", "abc") == 1.0 and like("", "") == 0.0 and like("ab", "cd") == 0.0
    assert like("night", "nacht") == pytest.approx(0.25)
    assert one(spark, text.common_suffix_length(F.lit("a梅田駅前店"), F.lit("b梅田駅前店"))) == 5


def test_urls(spark):
    rows = ["HTTP://Example.com:80/a/b/?q=1#x", "ftp://example.com/a", "https://user@example.com/a", "https://example.com/admin/x"]
    assert values(spark, rows, lambda c: text.canonical_url(c, ["example.com"], ["admin"])) == ["https://example.com/a/b", None, None, None]


def test_clock(spark):
    assert values(spark, ["24:00", "24:01", "9:05", "9:60", "x", None], times.minutes) == [1440, None, 545, None, None, None]
    assert values(spark, ["25:30"], times.long_minutes) == [1530]


@pytest.mark.parametrize(
    ("opens", "closes", "minute", "expected"),
    [(540, 1080, 539, False), (540, 1080, 540, True), (540, 1080, 1079, True), (540, 1080, 1080, False), (1080, 120, 119, True), (1080, 120, 120, False), (1080, 120, 1080, True), (0, 1440, 700, True), (540, 540, 3, True), (1440, 1440, 3, False)],
)
def test_hours(spark, opens, closes, minute, expected):
    assert one(spark, hours.covers(hours.segments(F.lit(opens), F.lit(closes)), F.lit(minute))) is expected


def test_hours_algebra(spark):
    ranges = lambda *r: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in r])
    got = one(spark, hours.merge(hours.subtract(ranges((0, 100), (90, 200), (300, 300)), ranges((50, 60)))))
    assert [tuple(r) for r in got] == [(0, 50), (60, 200)]
    spill = lambda today, before, m: one(spark, hours.with_spill(ranges(*today), ranges(*before), F.lit(m)))
    assert spill([(540, 600)], [(1080, 120)], 60) and not spill([(1080, 120)], [(540, 600)], 60)


def test_projection(spark):
    plan = F.from_json(F.lit('{"monday":{"open":"09:00","close":"18:00","break_enabled":true,"break_start":"12:00","break_end":"13:00"},"tuesday":{"closed":true}}'), arrays.SCHEDULE)
    shop = lambda holiday: spark.range(1).select(F.col("id").alias("shop_id"), plan.alias("schedule"), F.lit("日 10:00-12:00").alias("hours_text"), F.lit(holiday).cast("string").alias("holiday_text"))
    assert sorted(tuple(r)[1:] for r in weekly.projection(shop(None)).collect()) == [(0, 600, 720), (1, 540, 720), (1, 780, 1080)]
    assert {tuple(r)[1:] for r in weekly.projection(shop("祝 11:00-15:00")).collect()} == {(d, 660, 900) for d in range(7)}


def test_arrays(spark):
    assert one(spark, arrays.clean_list(F.array(F.lit(" a "), F.lit(""), F.lit("a"), F.lit("z")), ["a", "b"])) == ["a"]
    assert one(spark, arrays.day_range(F.lit(5), F.lit(1))) == [5, 6, 0, 1]


def test_scores_have_gaps(spark):
    assert [one(spark, scores.position_multiplier(F.lit(x))) for x in (3.0, 3.5, 4.0, 20.5, 60.0)] == [0.6, 0.7, 1.0, 0.7, 0.7]
    assert one(spark, geo.rate(F.lit(1), F.lit(0))) == 0.0


def test_linkage(spark):
    rows = [(1, "abc", "c", "s1", "s1|", True, None), (2, "abd", "c", "s2", "s2|", True, "u1")]
    targets = spark.createDataFrame(rows, "id int, name string, city string, street string, address string, complete boolean, url string")
    file = spark.createDataFrame([(11, "abc", "c", "s1", "s1|", True, "u9"), (12, "abd", "c", "s2", "s2|", True, "u1"), (13, "zzz", "d", "s3", "s3|", True, None)], targets.schema)
    matches, verdicts = linkage.classified(targets, file, linkage.candidate_pairs(targets, file))
    assert {(r["target"], r["row"], r["score"], r["class"]) for r in matches.collect()} == {(1, 11, 400, "bulk"), (2, 12, 400, "registered")}
    assert {tuple(r) for r in verdicts.collect()} == {(1, "bulk"), (2, "registered")}


def test_merging(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "b", "z"), (3, "c", "z")], old.schema)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(merging.upsert(old, new, ["id"])) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "z")]
    assert rows(merging.upsert(old, new, ["id"], ["v"])) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]
    assert rows(merging.fill_blank(old, new, "id", ["v", "w"])) == [(1, "a", "x"), (2, "b", "y")]
    assert rows(merging.overlay(old, new, "id", ["w"])) == [(1, "a", "x"), (2, "", "z")]


def test_review(spark):
    columns = "state eligible shop_exists approved unchanged bulk identity_count url_valid url_taken has_url same_url allow_replace".split()
    good = ("pending", True, True, True, True, True, 1, True, False, False, False, False)
    change = lambda **k: tuple(k.get(c, v) for c, v in zip(columns, good))
    df = spark.createDataFrame([good, change(identity_count=2), change(url_taken=True), change(same_url=True), change(has_url=True), change(state="applied")], columns)
    assert [r["state"] for r in review.applied(df).collect()] == ["applied", "conflict", "url_conflict", "skipped", "conflict", "applied"]


def test_pages_of_a_listing(spark):
    df = spark.range(25).withColumnRenamed("id", "shop_id")
    ids = lambda number, total=25: [r[0] for r in ranking.page(df, [F.asc("shop_id")], number, 10, total).collect()]
    assert ids(3) == list(range(20, 25)) and ids(9) == list(range(10))


def test_viewport_is_checked(spark):
    with pytest.raises(ValueError):
        predicates.in_viewport(spark.range(1), 2, 1, 0, 1)


def test_csv(spark, tmp_path):
    path = tmp_path / "report.csv"
    path.write_text("# made today\n# \npage,views\n/a,1\n\n/b,2\n")
    assert [tuple(r) for r in files.csv_after_preamble(spark, str(path), "page").collect()] == [("/a", "1"), ("/b", "2")]
    guessed = files.csv_with_header_guess(spark, str(path), ["views"])
    assert [tuple(r) for r in files.resolve_columns(guessed, {"path": ["Page", "path"], "n": ["views"], "none": ["x"]}).collect()] == [("/a", "1", None), ("/b", "2", None)]


def test_decoding(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_bytes('店名,住所\n"甲\n乙",x\na"b,y\n丙,z\n'.encode("cp932"))
    lines = files.decoded_lines(spark, str(path))
    assert [r["line"] for r in lines.collect()][:2] == ["店名,住所", '"甲']
    path.write_bytes(b"a\n\x81\n")
    with pytest.raises(Exception, match="line 2 cannot be decoded"):
        files.decoded_lines(spark, str(path)).collect()


def test_strict_csv_records(spark):
    lines = lambda *x: spark.createDataFrame(list(enumerate(x, 1)), "line_number int, line string")
    rows = files.strict_csv(lines("n,a", '"x', 'y",1', "z,2"), ["n", "a"]).orderBy("line_number").collect()
    assert [tuple(r) for r in rows] == [(2, "x\ny", "1", True), (4, "z", "2", True)]
    with pytest.raises(ValueError, match="never closed"):
        files.strict_csv(lines("n,a", '"x,1'), ["n", "a"])
    with pytest.raises(ValueError, match="lacks"):
        files.strict_csv(lines("n,b", "1,2"), ["n", "a"])


def test_streaming(spark, tmp_path):
    from placeworks.streaming import daily_counts, first_visits, first_visits_batch

    rows = [(1, 1, "/a", "v", "2024-01-01 10:00:00"), (2, 1, "/a", "v", "2024-01-01 11:00:00"), (3, 1, "/a", "v", "2024-01-02 10:00:00"), (4, 2, "/a", "v", "2024-01-02 10:00:00")]
    df = spark.createDataFrame(rows, "event_id int, shop_id int, path string, visitor string, created_at string").withColumn("created_at", F.to_timestamp("created_at")).withColumn("is_bot", F.lit(False))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(first_visits(stream), "visits").count() == first_visits_batch(df).count() == 3
    run(daily_counts(stream), "days")


def test_trailing_counts_and_delivery(spark, tmp_path):
    """Days and trailing windows of a stream against plain counts, and each key delivered once though rows repeat."""
    from collections import Counter
    from datetime import date, datetime, timedelta

    from placeworks.streaming import daily_counts, deliver, trailing_counts

    days = [date(2024, 1, d) for d in (1, 1, 2, 4, 4, 4, 9, 20)]  # the last one only moves the watermark on
    rows = [(k, datetime(d.year, d.month, d.day, 12)) for k, d in enumerate(days)]
    df = spark.createDataFrame(rows, "event_id int, created_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name):
        # a second, empty trigger lets the watermark of the first close its windows
        for _ in range(2):
            out.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}_state")).start(str(tmp_path / name)).awaitTermination(120)
        return {r["day"]: r["n"] for r in spark.read.parquet(str(tmp_path / name)).collect()}

    closed = Counter(d for d in days if d < date(2024, 1, 19))
    assert run(daily_counts(stream()), "daily") == closed
    got = run(trailing_counts(stream(), 3), "trailing")
    assert got == {end: n for k in range(30) if (n := sum(c for d, c in closed.items() if (end := date(2024, 1, 1) + timedelta(k)) - timedelta(3) <= d < end)) and end <= date(2024, 1, 19)}
    events = df.withColumn("shop_id", F.col("event_id") % 3)
    events.unionByName(events).coalesce(1).write.parquet(str(tmp_path / "twice"))
    again = spark.readStream.schema(events.schema).parquet(str(tmp_path / "twice"))
    deliver(again, str(tmp_path / "out"), str(tmp_path / "out_state"), ["event_id", "shop_id"]).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("key").count().filter("count > 1").count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(days)
