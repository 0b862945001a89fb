"""Roles of a directory bound to the tables at hand: the same projections in Spark and in SQL.

``Tables`` gives the roles as DataFrames, ``with_roles`` the SQL statement with those it uses.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeworks.sources import table

AS_OF = datetime(2024, 1, 31)
AS_OF_DAY = date(2024, 1, 31)


def now():
    """The reference time of all queries, as a column."""
    return F.lit(AS_OF).cast("timestamp_ntz")


def today():
    return F.lit(AS_OF_DAY)


SQL = {
    "b_shop": """SELECT c_custkey AS shop_id, c_name AS name, c_mktsegment AS genre, n_name AS area, CAST(c_custkey % 3 AS INTEGER) AS smoking_area,
        CAST(c_custkey % 4 AS INTEGER) AS smoking_type, c_acctbal >= 0 AS approved, c_custkey % 10 = 7 AS on_hold,
        34.6e0 + ((c_custkey * 37) % 1000) / 5000.0e0 AS lat, 135.4e0 + ((c_custkey * 91) % 1000) / 5000.0e0 AS lon,
        CASE WHEN c_custkey % 6 <> 0 THEN DATE '2024-01-31' - CAST((c_custkey * 13) % 500 AS INTEGER) END AS last_confirmed_on,
        DATE '2023-01-01' + CAST(c_custkey % 365 AS INTEGER) AS created_on
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "b_event": """SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "b_view": """SELECT event_id, user_id AS shop_id, k AS visitor, value > 450 AS is_bot, ts AS created_at FROM b_event WHERE event_type = 'view'""",
    "b_click": """SELECT event_id, user_id AS shop_id, CASE event_type WHEN 'click' THEN 'article_shop_click' WHEN 'purchase' THEN 'affiliate_click'
        WHEN 'signup' THEN 'phone_click' ELSE 'map_click' END AS kind, CASE WHEN event_type = 'click' AND k < 40 THEN k END AS article_id, ts AS created_at
        FROM b_event WHERE event_type <> 'view'""",
    "b_article": """SELECT doc_id AS article_id, text AS title, source || '-' || CAST(doc_id AS VARCHAR) AS slug, lang <> 'fr' AS published FROM documents""",
    "b_review": """SELECT o_custkey AS shop_id, CAST(1 + l_linenumber % 5 AS INTEGER) AS rating, l_returnflag <> 'R' AS approved, l_shipdate AS created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "b_report": """SELECT o_orderkey AS id, o_custkey AS shop_id, o_orderstatus AS status, o_orderpriority AS reason, o_orderdate AS updated_at FROM orders""",
    "b_hours": """SELECT o_custkey AS shop_id, CAST(o_orderkey % 7 AS INTEGER) AS weekday, CAST((o_orderkey * 37) % 1441 AS INTEGER) AS open_min,
        CAST((o_orderkey * 53) % 1441 AS INTEGER) AS close_min FROM orders""",
    "b_querylog": """SELECT p_name AS query, '/p/' || CAST(p_partkey AS VARCHAR) AS page, CAST(1 + p_size AS INTEGER) AS pos, CAST(sum(l_quantity) AS BIGINT) AS impressions,
        count(*) FILTER (WHERE l_returnflag = 'R') AS clicks FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL""",
    "b_record": """SELECT doc_id AS id, lower(text) AS name, lang AS city, source AS street FROM documents""",
    "b_window": """SELECT shop_id, weekday, r.s AS opens, r.e AS closes FROM (SELECT shop_id, weekday, unnest(CASE
        WHEN open_min = 1440 AND close_min = 1440 THEN [] WHEN open_min = close_min THEN [{'s': 0, 'e': 1440}]
        WHEN open_min = 1440 THEN [{'s': 0, 'e': close_min}] WHEN close_min = 0 THEN [{'s': open_min, 'e': 1440}]
        WHEN open_min < close_min THEN [{'s': open_min, 'e': close_min}] ELSE [{'s': 0, 'e': close_min}, {'s': open_min, 'e': 1440}] END) AS r FROM b_hours)""",
    "b_rating": """SELECT shop_id, avg(rating) FILTER (WHERE approved) AS avg_rating, count(*) FILTER (WHERE approved) AS review_count FROM b_review GROUP BY shop_id""",
}


def with_roles(body: str) -> str:
    """The statement with a common table expression for each role it names, directly or through another."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                need(SQL[name])
                wanted.append(name)

    need(body)
    if not wanted:
        return body
    ctes = ",\n".join(f"{name} AS ({SQL[name]})" for name in wanted)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Base tables and roles of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def shop(self) -> DataFrame:
        k = F.col("c_custkey")
        place = lambda start, factor: F.lit(start) + (k * factor) % 1000 / F.lit(5000.0)
        rows = self.base("customer").join(self.base("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select(
            k.alias("shop_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("genre"), F.col("n_name").alias("area"),
            (k % 3).cast("int").alias("smoking_area"), (k % 4).cast("int").alias("smoking_type"), (F.col("c_acctbal") >= 0).alias("approved"), (k % 10 == 7).alias("on_hold"),
            place(34.6, 37).alias("lat"), place(135.4, 91).alias("lon"),
            F.when(k % 6 != 0, F.date_sub(F.lit(AS_OF_DAY), (k * 13 % 500).cast("int"))).alias("last_confirmed_on"),
            F.date_add(F.lit(date(2023, 1, 1)), (k % 365).cast("int")).alias("created_on"),
        )

    @cached_property
    def event(self) -> DataFrame:
        return self.base("events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).drop("props")

    @cached_property
    def view(self) -> DataFrame:
        return self.event.filter("event_type = 'view'").select("event_id", F.col("user_id").alias("shop_id"), F.col("k").alias("visitor"), (F.col("value") > 450).alias("is_bot"), F.col("ts").alias("created_at"))

    @cached_property
    def click(self) -> DataFrame:
        t = F.col("event_type")
        kind = F.when(t == "click", "article_shop_click").when(t == "purchase", "affiliate_click").when(t == "signup", "phone_click").otherwise("map_click")
        return self.event.filter(t != "view").select("event_id", F.col("user_id").alias("shop_id"), kind.alias("kind"), F.when((t == "click") & (F.col("k") < 40), F.col("k")).alias("article_id"), F.col("ts").alias("created_at"))

    @cached_property
    def article(self) -> DataFrame:
        return self.base("documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("title"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("slug"), (F.col("lang") != "fr").alias("published"))

    @cached_property
    def review(self) -> DataFrame:
        rows = self.base("lineitem").join(self.base("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.select(F.col("o_custkey").alias("shop_id"), (1 + F.col("l_linenumber") % 5).cast("int").alias("rating"), (F.col("l_returnflag") != "R").alias("approved"), F.col("l_shipdate").alias("created_at"))

    @cached_property
    def report(self) -> DataFrame:
        return self.base("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("shop_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("reason"), F.col("o_orderdate").alias("updated_at"))

    @cached_property
    def hours(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.base("orders").select(F.col("o_custkey").alias("shop_id"), (k % 7).cast("int").alias("weekday"), (k * 37 % 1441).cast("int").alias("open_min"), (k * 53 % 1441).cast("int").alias("close_min"))

    @cached_property
    def querylog(self) -> DataFrame:
        rows = self.base("part").join(self.base("lineitem"), F.col("p_partkey") == F.col("l_partkey"))
        keys = [F.col("p_name").alias("query"), F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("page"), (1 + F.col("p_size")).cast("int").alias("pos")]
        return rows.groupBy(*keys).agg(F.sum("l_quantity").cast("long").alias("impressions"), F.count_if(F.col("l_returnflag") == "R").alias("clicks"))

    @cached_property
    def record(self) -> DataFrame:
        return self.base("documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("name"), F.col("lang").alias("city"), F.col("source").alias("street"))

    @cached_property
    def rating(self) -> DataFrame:
        ok = F.col("approved")
        return self.review.groupBy("shop_id").agg(F.avg(F.when(ok, F.col("rating"))).alias("avg_rating"), F.count_if(ok).alias("review_count"))
