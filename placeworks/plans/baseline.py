"""General operations over the base tables: grouping sets, frames, set operations, as-of joins, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeworks.plans.registry import query
from placeworks.plans.roles import Tables


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, count(*) AS n, CAST(round(sum(CAST(l_extendedprice * 100 AS BIGINT))) AS BIGINT) AS cents FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def g01_pricing_summary(t: Tables):
    rows = t.base("lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.count("*").alias("n"), cents.alias("cents"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def g02_grouping_sets(t: Tables):
    return t.base("orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def g03_cube(t: Tables):
    return t.base("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def g04_rollup(t: Tables):
    return t.base("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM b_event")
def g05_frames_and_lag(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.event.select("event_id", F.sum("k").over(w.rowsBetween(-2, 0)).alias("recent"), F.lag("event_type").over(w).alias("before"))


@query("SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INTEGER) AS quarter FROM customer")
def g06_ntile(t: Tables):
    return t.base("customer").select("c_custkey", F.ntile(4).over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")).alias("quarter"))


@query("SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events")
def g07_intersect(t: Tables):
    return t.base("orders").select(F.col("o_custkey").alias("id")).intersect(t.base("events").select("user_id"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events")
def g08_except(t: Tables):
    return t.base("customer").select(F.col("c_custkey").alias("id")).subtract(t.base("events").select("user_id"))


@query("""SELECT v.event_id, (SELECT max((c.ts, c.event_id)) FROM events c WHERE c.event_type = 'click' AND c.user_id = v.user_id AND c.ts <= v.ts)['event_id'] AS last_click FROM events v WHERE v.event_type = 'purchase'""".replace("max((c.ts, c.event_id))", "max({'ts': c.ts, 'event_id': c.event_id})"))
def g09_as_of_join(t: Tables):
    """Each purchase with the user's latest click: both sides in one ordering, the last click carried on; one shuffle and no pairs."""
    e = t.base("events")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), True).over(w)
    both = e.filter(F.col("event_type").isin("click", "purchase")).withColumn("last_click", last)
    return both.filter("event_type = 'purchase'").select("event_id", "last_click")


@query("""SELECT user_id, session, count(*) AS events, min(ts) AS begins FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY ALL""".replace("SELECT user_id, session,", "SELECT user_id, CAST(session AS BIGINT) AS session,").replace("GROUP BY ALL", "GROUP BY user_id, session"))
def g10_sessions(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    rows = t.base("events").withColumn("fresh", F.when(gap <= F.expr("INTERVAL 12 HOUR"), 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("begins"))
