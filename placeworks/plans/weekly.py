"""Opening hours: segments, merging, subtraction, points in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeworks.functions import hours as H
from placeworks.operators.weekly import exploded, merged_windows, open_at
from placeworks.plans.registry import query
from placeworks.plans.roles import Tables

_MERGED = """SELECT shop_id, weekday, min(opens) AS opens, max(closes) AS closes FROM (SELECT *, sum(fresh) OVER (PARTITION BY shop_id, weekday ORDER BY opens, closes ROWS UNBOUNDED PRECEDING) AS island
FROM (SELECT shop_id, weekday, opens, closes, CASE WHEN opens > coalesce(max(closes) OVER (PARTITION BY shop_id, weekday ORDER BY opens, closes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh
FROM (SELECT DISTINCT shop_id, weekday, opens, closes FROM b_window WHERE opens < closes))) GROUP BY shop_id, weekday, island"""


@query("SELECT shop_id, weekday, opens, closes FROM b_window")
def i01_segments(t: Tables):
    return exploded(t.hours).select("shop_id", "weekday", "opens", "closes")


@query("""SELECT shop_id, weekday, CAST(greatest(opens, 780) AS INTEGER) AS opens, closes FROM b_window WHERE closes > 780 UNION ALL SELECT shop_id, weekday, opens, CAST(least(closes, 720) AS INTEGER) FROM b_window WHERE opens < 720""")
def i02_subtract_lunch(t: Tables):
    """Hours without 12:00 to 13:00."""
    lunch = F.array(F.struct(F.lit(720).alias("start"), F.lit(780).alias("end")))
    left = H.subtract(H.segments(F.col("open_min"), F.col("close_min")), lunch)
    return t.hours.select("shop_id", "weekday", F.explode(left).alias("r")).select("shop_id", "weekday", F.col("r.start").alias("opens"), F.col("r.end").alias("closes"))


@query(_MERGED)
def i03_merge(t: Tables):
    return merged_windows(exploded(t.hours).select("shop_id", "weekday", "opens", "closes").distinct(), ["shop_id", "weekday"])


@query(_MERGED)
def q28_projection(t: Tables):
    """The same by folding each shop's ranges as one array."""
    ranges = exploded(t.hours).groupBy("shop_id", "weekday").agg(F.collect_set(F.struct(F.col("opens").alias("start"), F.col("closes").alias("end"))).alias("ranges"))
    return ranges.select("shop_id", "weekday", F.explode(H.merge(F.col("ranges"))).alias("r")).select("shop_id", "weekday", F.col("r.start").alias("opens"), F.col("r.end").alias("closes"))


@query("SELECT DISTINCT shop_id FROM b_window WHERE weekday = 5 AND opens <= 1320 AND closes > 1320")
def q29_open_now(t: Tables):
    return open_at(exploded(t.hours), 5, 1320)


@query("SELECT shop_id, weekday, open_min, close_min, coalesce(bool_or(s <= 600 AND 600 < e), false) AS is_open FROM (SELECT shop_id, weekday, open_min, close_min, w.opens AS s, w.closes AS e FROM b_hours h LEFT JOIN b_window w USING (shop_id, weekday)) GROUP BY ALL")
def i05_open_at_ten(t: Tables):
    """Whether any of a shop's ranges on a row's weekday holds ten o'clock."""
    ranges = F.flatten(F.collect_list(H.segments(F.col("open_min"), F.col("close_min"))))
    by_day = t.hours.groupBy("shop_id", "weekday").agg(H.covers(ranges, F.lit(600)).alias("is_open"))
    return t.hours.distinct().join(by_day, ["shop_id", "weekday"]).select("shop_id", "weekday", "open_min", "close_min", "is_open")


@query("""WITH t(shop_id, s, e) AS (SELECT shop_id, 60 * CAST(regexp_extract(x, '([0-9]+):([0-9]+)-([0-9]+):([0-9]+)', 1) AS INTEGER) + CAST(regexp_extract(x, '([0-9]+):([0-9]+)-([0-9]+):([0-9]+)', 2) AS INTEGER),
60 * CAST(regexp_extract(x, '([0-9]+):([0-9]+)-([0-9]+):([0-9]+)', 3) AS INTEGER) + CAST(regexp_extract(x, '([0-9]+):([0-9]+)-([0-9]+):([0-9]+)', 4) AS INTEGER) FROM (SELECT shop_id,
lpad(CAST(open_min // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(open_min % 60 AS VARCHAR), 2, '0') || '-' || lpad(CAST(close_min // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(close_min % 60 AS VARCHAR), 2, '0') AS x FROM b_hours))
SELECT shop_id, CAST(s AS INTEGER) AS opens, CAST(e AS INTEGER) AS closes FROM t""")
def i06_text_ranges(t: Tables):
    clock = lambda c: F.concat(F.lpad(F.floor(F.col(c) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col(c) % 60).cast("string"), 2, "0"))
    text = F.concat(F.lit("Mon "), clock("open_min"), F.lit("-"), clock("close_min"), F.lit("\nTue 01:00-02:00"))
    rows = t.hours.select("shop_id", F.explode(H.text_ranges(text, "Mon")).alias("r"))
    return rows.select("shop_id", F.col("r.start").alias("opens"), F.col("r.end").alias("closes"))


@query("""SELECT o_orderkey, (s >= 540 AND e2 <= 1500) OR (s + 1440 >= 540 AND e2 + 1440 <= 1500) AS within FROM (SELECT o_orderkey, s, CASE WHEN e <= s THEN e + 1440 ELSE e END AS e2 FROM
(SELECT o_orderkey, (o_orderkey * 37) % 1441 AS s, (o_orderkey * 53) % 1441 AS e FROM orders))""")
def i10_within(t: Tables):
    k = F.col("o_orderkey")
    return t.base("orders").select(k, H.contains_range(F.lit(540), F.lit(60), k * 37 % 1441, k * 53 % 1441).alias("within"))


@query("SELECT shop_id, weekday, opens, closes, count(*) AS n FROM b_window GROUP BY ALL HAVING count(*) > 1")
def v01_unique_windows(t: Tables):
    """Windows that a shop has more than once before they are merged."""
    return exploded(t.hours).groupBy("shop_id", "weekday", "opens", "closes").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey * 37) % 1500 > 1440 OR o_orderkey % 8 > 6")
def v02_minutes_in_range(t: Tables):
    """Rows whose minute or weekday no window may have."""
    k = F.col("o_orderkey")
    return t.base("orders").filter((k * 37 % 1500 > 1440) | (k % 8 > 6)).select(k)
