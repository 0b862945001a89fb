"""Search, ranking and recommendation (Q01-Q07, Q30-Q37, F, J, O, U, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeworks.functions.geo import extent, haversine_m, pages, walking_minutes
from placeworks.functions.text import list_items
from placeworks.operators import joins as J
from placeworks.operators import merging as M
from placeworks.operators import predicates as P
from placeworks.operators import ranking as R
from placeworks.operators.weekly import exploded, open_at
from placeworks.plans.registry import query
from placeworks.plans.roles import Tables, now, today

_D = "CAST(round(2 * 6371000.0e0 * asin(sqrt(least(pow(sin(radians({b} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({b})) * pow(sin(radians({c} - lon) / 2), 2), 1.0e0)))) AS BIGINT)"
_OPEN = "shop_id IN (SELECT shop_id FROM b_window WHERE weekday = 3 AND opens <= 600 AND closes > 600)"


def _open_now(t: Tables, df):
    return df.join(open_at(exploded(t.hours), 3, 600).withColumn("open_now", F.lit(True)), "shop_id", "left").fillna(False, ["open_now"])


def _origin(t: Tables):
    """The first shop, whose place the recommendations are for."""
    return 34.6 + 37 / 5000.0, 135.4 + 91 / 5000.0


@query(f"""SELECT shop_id, name, coalesce(review_count, 0) AS review_count, {_OPEN} AS open_now FROM b_shop LEFT JOIN b_rating USING (shop_id)
WHERE approved AND NOT on_hold AND genre IN ('BUILDING', 'MACHINERY') AND (last_confirmed_on IS NULL OR last_confirmed_on >= DATE '2022-01-31')
ORDER BY last_confirmed_on IS NULL, last_confirmed_on DESC NULLS LAST, coalesce(avg_rating, 0) DESC, coalesce(review_count, 0) DESC, {_OPEN} DESC, created_on DESC, shop_id LIMIT 30 OFFSET 30""")
def q01_listing(t: Tables):
    """Second page of a filtered listing: reviews are aggregated before the join, one plan ranks and cuts."""
    shops = P.approved(t.shop).filter(F.col("genre").isin("BUILDING", "MACHINERY") & ~(F.col("last_confirmed_on").isNotNull() & P.stale(F.col("last_confirmed_on"), today())))
    rows = _open_now(t, shops.join(t.rating, "shop_id", "left").fillna(0, ["avg_rating", "review_count"])).withColumn("low_priority", F.lit(0))
    return R.page(rows, R.listing_order("rating"), 2, 30).select("shop_id", "name", "review_count", "open_now")


@query("SELECT shop_id, " + _D.format(b="34.7e0", c="135.5e0") + " AS metres FROM b_shop WHERE approved AND NOT on_hold AND lat BETWEEN 34.68e0 AND 34.72e0 AND lon BETWEEN 135.48e0 AND 135.52e0 AND " + _D.format(b="34.7e0", c="135.5e0") + " <= 1500")
def q02_map(t: Tables):
    box = P.in_viewport(P.approved(t.shop), 34.68, 34.72, 135.48, 135.52)
    return J.within_radius(box, 34.7, 135.5, 1500.49).select("shop_id", F.floor(F.col("distance_m") + 0.5).cast("long").alias("metres")).filter("metres <= 1500")


_AT = {"b": "(34.6e0 + 37 / 5000.0e0)", "c": "(135.4e0 + 91 / 5000.0e0)"}


@query(f"""SELECT shop_id, {_OPEN} AS open_now, {_D.format(**_AT)} AS metres FROM b_shop WHERE approved AND NOT on_hold AND shop_id <> 1 AND smoking_area = 1 AND {_D.format(**_AT)} < 3000
ORDER BY open_now DESC, last_confirmed_on IS NULL, created_on DESC, shop_id LIMIT 6""")
def q03_nearby(t: Tables):
    lat, lon = _origin(t)
    near = J.within_radius(P.approved(t.shop).filter("shop_id <> 1 and smoking_area = 1"), lat, lon, 3000).withColumn("dated", F.col("last_confirmed_on").isNotNull())
    near = near.withColumn("metres", F.floor(F.col("distance_m") + 0.5).cast("long")).filter("metres < 3000")
    return R.top(_open_now(t, near), 6, *R.NEARBY_ORDER).select("shop_id", "open_now", "metres")


@query(f"""SELECT shop_id, {_OPEN} AS open_now FROM b_shop WHERE approved AND NOT on_hold AND shop_id <> 1 AND genre = (SELECT genre FROM b_shop WHERE shop_id = 1) AND {_D.format(**_AT)} < 5000
ORDER BY open_now DESC, last_confirmed_on IS NULL, created_on DESC, shop_id LIMIT 6""")
def q04_same_genre(t: Tables):
    lat, lon = _origin(t)
    mine = t.shop.filter("shop_id = 1").select("genre")
    same = P.approved(t.shop).filter("shop_id <> 1").join(mine, "genre", "left_semi")
    near = J.within_radius(same, lat, lon, 5000).filter(F.floor(F.col("distance_m") + 0.5) < 5000).withColumn("dated", F.col("last_confirmed_on").isNotNull())
    return R.top(_open_now(t, near), 6, *R.NEARBY_ORDER).select("shop_id", "open_now")


_CLICKS = "LEFT JOIN (SELECT shop_id, count(*) AS clicks FROM b_click GROUP BY 1) c USING (shop_id)"


@query(f"""SELECT shop_id, {_D.format(**_AT)} AS metres, coalesce(clicks, 0) AS clicks FROM b_shop {_CLICKS} WHERE approved AND NOT on_hold AND shop_id <> 1 AND {_D.format(**_AT)} < 3000
ORDER BY metres, clicks DESC, last_confirmed_on IS NULL, last_confirmed_on DESC NULLS LAST, created_on DESC, shop_id LIMIT 6""")
def q05_popular_near(t: Tables):
    lat, lon = _origin(t)
    near = J.within_radius(P.approved(t.shop).filter("shop_id <> 1"), lat, lon, 3000).withColumn("distance_m", F.floor(F.col("distance_m") + 0.5).cast("long")).filter("distance_m < 3000")
    rows = J.with_counts(near.withColumn("dated", F.col("last_confirmed_on").isNotNull()), t.click, "shop_id", "clicks")
    return R.top(rows, 6, *R.POPULAR_ORDER).select("shop_id", F.col("distance_m").alias("metres"), "clicks")


@query(f"""SELECT shop_id, coalesce(clicks, 0) AS clicks FROM b_shop {_CLICKS} WHERE approved AND NOT on_hold AND shop_id <> 1
ORDER BY coalesce(clicks, 0) DESC, last_confirmed_on IS NULL, last_confirmed_on DESC NULLS LAST, created_on DESC, shop_id LIMIT 6""")
def q05b_popular(t: Tables):
    rows = J.with_counts(P.approved(t.shop).filter("shop_id <> 1").withColumn("dated", F.col("last_confirmed_on").isNotNull()), t.click, "shop_id", "clicks")
    return R.top(rows, 6, *R.POPULAR_ORDER_ANYWHERE).select("shop_id", "clicks")


@query(f"SELECT shop_id, coalesce(clicks, 0) AS clicks FROM b_shop {_CLICKS} WHERE approved AND NOT on_hold ORDER BY coalesce(clicks, 0) DESC, shop_id LIMIT 3")
def q06_popular_for_article(t: Tables):
    return R.top(J.with_counts(P.approved(t.shop).select("shop_id"), t.click, "shop_id", "clicks"), 3, "clicks desc", "shop_id")


@query("""WITH last AS (SELECT shop_id, arg_max(reason, (updated_at, id)) AS reason FROM b_report WHERE status = 'F' GROUP BY 1)
SELECT s.shop_id FROM b_shop s JOIN last USING (shop_id) WHERE reason IN ('1-URGENT', '2-HIGH')""")
def q30_confirmed_set(t: Tables):
    """Shops by the reason of their latest report."""
    return P.latest_reason_in(t.shop, t.report, "F", ["1-URGENT", "2-HIGH"]).select("shop_id")


@query("SELECT count(*) AS n FROM b_shop WHERE last_confirmed_on IS NULL OR area IS NULL")
def q32_missing_scan(t: Tables):
    return t.shop.filter(F.col("last_confirmed_on").isNull() | F.col("area").isNull()).agg(F.count("*").alias("n"))


@query("SELECT article_id, title FROM b_article WHERE published AND slug LIKE '%src1%' ORDER BY article_id DESC LIMIT 20")
def q33_published_articles(t: Tables):
    return t.article.filter(F.col("published") & F.col("slug").contains("src1")).select("article_id", "title").orderBy(F.desc("article_id")).limit(20)


@query("SELECT count(*) AS n FROM b_review v WHERE EXISTS (SELECT 1 FROM b_report r WHERE r.shop_id = v.shop_id AND status = 'P')")
def q34_reported_reviews(t: Tables):
    return t.review.join(t.report.filter("status = 'P'"), "shop_id", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT genre FROM (SELECT DISTINCT genre FROM b_shop) ORDER BY genre = 'FURNITURE', genre")
def q35_genre_options(t: Tables):
    return R.options(t.shop, "genre", "FURNITURE")


@query("SELECT shop_id, name FROM b_shop WHERE name LIKE '%000%' ORDER BY shop_id LIMIT 30 OFFSET 30")
def q36_station_page(t: Tables):
    return R.page(t.shop.filter(F.col("name").contains("000")).select("shop_id", "name"), [F.asc("shop_id")], 2, 30)


@query("SELECT a.article_id FROM b_article a JOIN documents d ON d.doc_id = a.article_id WHERE published AND (lower(title) LIKE '%the%' OR lower(text) LIKE '%license%')")
def q37_article_search(t: Tables):
    rows = t.article.join(t.base("documents").select(F.col("doc_id").alias("article_id"), "text"), "article_id")
    return rows.filter(F.col("published") & (P.keyword([F.col("title")], "the") | P.keyword([F.col("text")], "license"))).select("article_id")


@query("SELECT shop_id FROM b_shop WHERE smoking_area IN (0, 2) OR last_confirmed_on IS NULL")
def f01_in_list_or_null(t: Tables):
    return t.shop.filter(P.among(F.col("smoking_area"), [0, 2]) | F.col("last_confirmed_on").isNull()).select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE last_confirmed_on IS NOT NULL AND last_confirmed_on NOT IN (DATE '2024-01-18', DATE '2024-01-05')")
def f02_not_in(t: Tables):
    from datetime import date

    return t.shop.filter(P.none_of(F.col("last_confirmed_on"), [date(2024, 1, 18), date(2024, 1, 5)])).select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE lat BETWEEN 34.65e0 AND 34.7e0 AND lon BETWEEN 135.45e0 AND 135.5e0")
def f03_viewport(t: Tables):
    return P.in_viewport(t.shop, 34.65, 34.7, 135.45, 135.5).select("shop_id")


@query("SELECT event_id FROM b_view WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def f04_time_range(t: Tables):
    return t.view.filter(P.since(F.col("created_at"), now(), 7)).select("event_id")


@query("SELECT event_id FROM b_view WHERE CAST(created_at AS DATE) = DATE '2024-01-15'")
def f05_same_day(t: Tables):
    return t.view.filter(P.same_day(F.col("created_at"), F.lit("2024-01-15"))).select("event_id")


@query("SELECT shop_id FROM b_shop WHERE last_confirmed_on IS NULL OR last_confirmed_on < DATE '2023-01-31'")
def f06_stale(t: Tables):
    return t.shop.filter(P.stale(F.col("last_confirmed_on"), today(), 12)).select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE contains(name, '0001')")
def f07_substring(t: Tables):
    return t.shop.filter(F.col("name").contains("0001")).select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE lower(name) LIKE '%#000_0%'")
def f08_wildcards(t: Tables):
    return t.shop.filter(F.lower("name").like("%#000_0%")).select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE contains(lower(name), 'build') OR contains(lower(genre), 'build') OR contains(lower(area), 'build')")
def f09_keyword(t: Tables):
    return t.shop.filter(P.keyword([F.col(c) for c in ("name", "genre", "area")], "Build")).select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE (contains(lower(name), 'build') OR contains(lower(genre), 'build')) AND (contains(lower(name), '00') OR contains(lower(genre), '00'))")
def f10_all_keywords(t: Tables):
    return P.all_keywords(t.shop, ["name", "genre"], "BUILD　00").select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE contains(lower(name || ' ' || genre), 'auto') AND contains(lower(name || ' ' || genre), '01')")
def f11_tokens_in_text(t: Tables):
    return t.shop.filter(P.all_tokens(F.concat_ws(" ", "name", "genre"), F.lit("auto 01"))).select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE list_has_any(string_split_regex(genre || '、' || area, '[、,]'), ['MACHINERY', 'NATION_3'])")
def f12_token_membership(t: Tables):
    return t.shop.filter(P.has_token([F.concat_ws("、", "genre", "area")], ["MACHINERY", "NATION_3"])).select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE contains(genre, 'BUILDING') OR contains(genre, 'HOUSE')")
def f13_expanded_terms(t: Tables):
    terms = P.expand_terms(["houses"], {"houses": "BUILDING"}, {"BUILDING": ["HOUSE"]})
    return t.shop.filter(P.contains_term([F.col("genre")], terms)).select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE contains(name, '12') OR contains(area, '12') OR contains(name, '7') OR contains(area, '7')")
def f15_terms_in_columns(t: Tables):
    return t.shop.filter(P.contains_term([F.col("name"), F.col("area")], ["12", "7"])).select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE smoking_type = 0 OR smoking_area = 0 OR (smoking_type = 1 AND smoking_area = 2) OR (smoking_type = 2 AND smoking_area = 1)")
def f17_composite_type(t: Tables):
    return t.shop.filter(P.type_matches(0, True, F.col("smoking_type"), F.col("smoking_area"))).select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE approved AND NOT on_hold")
def f18_visible(t: Tables):
    return P.approved(t.shop).select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE shop_id IN (SELECT shop_id FROM b_report WHERE status = 'P') AND shop_id NOT IN (SELECT shop_id FROM b_view)")
def f20_semi_anti(t: Tables):
    return t.shop.join(t.report.filter("status = 'P'"), "shop_id", "left_semi").join(t.view, "shop_id", "left_anti").select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE shop_id NOT IN (SELECT shop_id FROM b_view)")
def f22_not_in_subquery(t: Tables):
    return t.shop.join(t.view, "shop_id", "left_anti").select("shop_id")


@query("SELECT DISTINCT shop_id FROM b_window WHERE weekday = 3 AND opens <= 600 AND closes > 600")
def f23_interval_stab(t: Tables):
    return open_at(exploded(t.hours), 3, 600)


_AGENTS = ("Mozilla/5.0", "Mozilla/5.0 (compatible; YandexImages/3.0)", "Embedly/0.2", "Pinterest/0.2", "curl/8.5", "python-requests/2", "SomeCrawl/1", "Googlebot/2.1")


@query("SELECT event_id, regexp_matches(lower(agent), 'bot|crawl|spider|slurp|bingpreview|duckduckbot|yandex|googlebot|baiduspider|facebookexternalhit|twitterbot|embedly|pinterest') AS bot FROM (SELECT event_id, [" + ", ".join(f"'{a}'" for a in _AGENTS) + "][1 + event_id % 8] AS agent FROM events)")
def f24_bots(t: Tables):
    agent = F.element_at(F.array(*[F.lit(a) for a in _AGENTS]), (1 + F.col("event_id") % 8).cast("int"))
    return t.base("events").select("event_id", P.is_bot(agent).alias("bot"))


@query("SELECT query, page FROM b_querylog WHERE NOT regexp_matches(lower(query), 'red|blue')")
def f25_noise(t: Tables):
    return t.querylog.filter(~F.lower("query").rlike("red|blue")).select("query", "page")


@query("SELECT shop_id, n FROM (SELECT shop_id, count(*) AS n, avg(rating) AS mean FROM b_review GROUP BY 1) WHERE n >= 20 AND mean < 3.0e0")
def f26_minimum_support(t: Tables):
    return P.with_support(t.review.groupBy("shop_id").agg(F.count("*").alias("n"), F.avg("rating").alias("mean")), "n", 20, "mean", 3.0).select("shop_id", "n")


@query("SELECT c_custkey AS shop_id, concat_ws(' / ', CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_custkey % 10 = 7 THEN 'held' END) AS errors FROM customer WHERE c_acctbal < 0 OR c_custkey % 10 = 7")
def f27_validation(t: Tables):
    rows = t.base("customer").withColumnRenamed("c_custkey", "shop_id")
    return P.invalid_rows(rows, {"negative balance": F.col("c_acctbal") < 0, "held": F.col("shop_id") % 10 == 7}).select("shop_id", "errors")


@query("SELECT event_id, name FROM b_click JOIN b_shop USING (shop_id)")
def j01_inner(t: Tables):
    return t.click.join(t.shop, "shop_id").select("event_id", "name")


@query("SELECT s.shop_id, count(v.event_id) AS views FROM b_shop s LEFT JOIN b_view v USING (shop_id) GROUP BY 1")
def j02_left_with_zero(t: Tables):
    return J.with_counts(t.shop.select("shop_id"), t.view, "shop_id", "views")


@query("SELECT s.shop_id, coalesce(n, 0) AS stars FROM b_shop s LEFT JOIN (SELECT shop_id, CAST(sum(rating) AS BIGINT) AS n FROM b_review GROUP BY 1) USING (shop_id)")
def j03_pre_aggregated(t: Tables):
    return J.with_counts(t.shop.select("shop_id"), t.review, "shop_id", "stars", F.sum("rating"))


@query("SELECT shop_id FROM b_shop WHERE EXISTS (SELECT 1 FROM b_click c WHERE c.shop_id = b_shop.shop_id)")
def j04_semi(t: Tables):
    return t.shop.join(t.click, "shop_id", "left_semi").select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE NOT EXISTS (SELECT 1 FROM b_click c WHERE c.shop_id = b_shop.shop_id)")
def j05_anti(t: Tables):
    return t.shop.join(t.click, "shop_id", "left_anti").select("shop_id")


@query("""WITH i AS (SELECT event_id, user_id AS shop_id, CAST(dayofweek(ts) AS INTEGER) AS weekday, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute FROM b_event)
SELECT event_id, w.shop_id, CAST(opens AS INTEGER) AS opens, CAST(closes AS INTEGER) AS closes FROM i JOIN b_window w ON i.shop_id = w.shop_id AND i.weekday = w.weekday AND opens <= i.minute AND i.minute < closes""")
def j08_interval_join(t: Tables):
    """Events against the hours of their shop: the windows it was open in at that moment, all of both."""
    instants = t.event.select("event_id", F.col("user_id").alias("shop_id"), (F.dayofweek("ts") - 1).alias("weekday"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))
    found = J.within_windows(instants, exploded(t.hours), 1440, keys=("shop_id",))
    return found.select("event_id", "shop_id", F.col("opens").cast("int").alias("opens"), F.col("closes").cast("int").alias("closes"))


@query("""WITH i AS (SELECT p_partkey, CAST(p_partkey % 7 AS INTEGER) AS weekday, CAST(p_partkey * 11 % 1440 AS INTEGER) AS minute FROM part), w AS (SELECT c_custkey AS shop_id, CAST(c_custkey % 7 AS INTEGER) AS weekday, CAST(c_custkey * 17 % 1400 AS INTEGER) AS opens, CAST(c_custkey * 17 % 1400 + 1 + c_custkey % 30 AS INTEGER) AS closes FROM customer)
SELECT p_partkey, w.shop_id FROM i JOIN w ON i.weekday = w.weekday AND opens <= i.minute AND i.minute < closes""")
def j08_short_windows(t: Tables):
    """Instants against short windows, all of both."""
    k, c = F.col("p_partkey"), F.col("c_custkey")
    instants = t.base("part").select(k, (k % 7).cast("int").alias("weekday"), (k * 11 % 1440).cast("int").alias("minute"))
    windows = t.base("customer").select(c.alias("shop_id"), (c % 7).cast("int").alias("weekday"), (c * 17 % 1400).cast("int").alias("opens"), (c * 17 % 1400 + 1 + c % 30).cast("int").alias("closes"))
    return J.within_windows(instants, windows).select("p_partkey", "shop_id")


@query("""WITH i AS (SELECT event_id, CAST(dayofweek(ts) AS INTEGER) AS weekday, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute FROM b_event),
n AS (SELECT m.weekday, m.minute, count(w.shop_id) AS open_windows FROM (SELECT DISTINCT weekday, minute FROM i) m LEFT JOIN b_window w ON m.weekday = w.weekday AND opens <= m.minute AND m.minute < closes GROUP BY 1, 2)
SELECT event_id, open_windows FROM i JOIN n USING (weekday, minute)""")
def j08_open_windows(t: Tables):
    """The interval join of every event, as the number of windows open at it: the pairs are events times windows."""
    instants = t.event.select("event_id", (F.dayofweek("ts") - 1).alias("weekday"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"))
    return J.count_windows(instants, exploded(t.hours), "open_windows").select("event_id", "open_windows")


_PAIR = "CAST(round(2 * 6371000.0e0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0e0)))) AS BIGINT)"


@query(f"SELECT a.shop_id AS a, b.shop_id AS b, {_PAIR} AS metres FROM b_shop a JOIN b_shop b ON a.shop_id <> b.shop_id AND a.shop_id % 50 = 0 WHERE {_PAIR} <= 800")
def j09_pairs_within_radius(t: Tables):
    """A stated set of shops against all, by grid cells."""
    points = t.shop.select(F.col("shop_id").alias("id"), "lat", "lon")
    near = J.pairs_within(points.filter("id % 50 = 0"), points, 801)
    return near.select("a", "b", F.floor(F.col("distance_m") + 0.5).cast("long").alias("metres")).filter("metres <= 800")


@query("SELECT DISTINCT q.query FROM b_querylog q WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part) n WHERE contains(replace(lower(q.query), ' ', ''), replace(lower(n.name), ' ', '')))")
def j10_name_in_query(t: Tables):
    names = t.base("part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).distinct()
    return J.names_in_queries(t.querylog.select("query").distinct(), names).select("query")


@query("""WITH r(rule_order, label, keyword) AS (VALUES (1, 'warm', 'red'), (2, 'cold', 'blue'), (3, 'plain', 'e')), q AS (SELECT DISTINCT query FROM b_querylog)
SELECT q.query, (SELECT arg_min(label, rule_order) FROM r WHERE contains(lower(q.query), keyword)) AS label FROM q""")
def j12_first_rule(t: Tables):
    rules = t.spark.createDataFrame([(1, "warm", "red"), (2, "cold", "blue"), (3, "plain", "e")], "rule_order int, label string, keyword string")
    return J.first_rule_join(t.querylog.select("query").distinct(), "query", rules, "query").select("query", "label")


@query("SELECT c.event_id, a.slug FROM b_click c LEFT JOIN b_article a ON c.kind = 'article_shop_click' AND c.article_id = a.article_id")
def j14_polymorphic(t: Tables):
    a = t.article.select("article_id", "slug", F.lit("article_shop_click").alias("kind"))
    return t.click.join(a, ["kind", "article_id"], "left").select("event_id", "slug")


@query("""SELECT doc_id AS id, count(*) OVER (PARTITION BY text) > 1 AS same_text, count(*) OVER (PARTITION BY n_chars) > 1 AS same_n_chars FROM documents""")
def j17_duplicate_flags(t: Tables):
    docs = t.base("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text"), "n_chars")
    return J.duplicate_flags(docs, "id", ["text", "n_chars"]).select("id", "same_text", "same_n_chars")


_ORDERS = {
    "rating": "coalesce(avg_rating, 0) DESC, coalesce(review_count, 0) DESC, created_on DESC",
    "reviews_count": "coalesce(review_count, 0) DESC, coalesce(avg_rating, 0) DESC, created_on DESC",
    "newest": "created_on DESC, coalesce(avg_rating, 0) DESC, coalesce(review_count, 0) DESC",
}


def _order_query(name: str):
    @query(f"SELECT shop_id, CAST(row_number() OVER (ORDER BY last_confirmed_on IS NULL, last_confirmed_on DESC NULLS LAST, {_ORDERS[name]}, shop_id) AS INTEGER) AS place FROM b_shop LEFT JOIN b_rating USING (shop_id) ORDER BY place LIMIT 100")
    def made(t: Tables):
        rows = t.shop.join(t.rating, "shop_id", "left").fillna(0, ["avg_rating", "review_count"]).withColumn("open_now", F.lit(False)).withColumn("low_priority", F.lit(0))
        from pyspark.sql.window import Window

        first = rows.orderBy(*R.listing_order(name)).limit(100)
        return first.select("shop_id", F.row_number().over(Window.orderBy(*R.listing_order(name))).alias("place"))

    return made


def _register_orders() -> None:
    from placeworks.plans.registry import ORACLE_SQL, QUERIES

    for name in _ORDERS:
        _order_query(name)
        QUERIES[f"o01_order_{name}"], ORACLE_SQL[f"o01_order_{name}"] = QUERIES.pop("made"), ORACLE_SQL.pop("made")


_register_orders()


@query("SELECT shop_id, last_confirmed_on FROM b_shop ORDER BY last_confirmed_on DESC NULLS LAST, shop_id LIMIT 300")
def o02_nulls_last(t: Tables):
    return t.shop.select("shop_id", "last_confirmed_on").orderBy(F.desc_nulls_last("last_confirmed_on"), "shop_id").limit(300)


@query("SELECT kind, n FROM (SELECT kind, count(*) AS n FROM b_click GROUP BY 1) ORDER BY n DESC, kind LIMIT 2")
def o07_top_k(t: Tables):
    return R.top(t.click.groupBy("kind").agg(F.count("*").alias("n")), 2, "n desc", "kind")


@query("SELECT shop_id, CAST(ceil((SELECT count(*) FROM b_shop) / 100.0e0) AS BIGINT) AS pages FROM b_shop ORDER BY shop_id LIMIT 100 OFFSET 100")
def o08_page(t: Tables):
    total = t.shop.agg(pages(F.count("*"), 100).alias("pages"))
    return R.page(t.shop.select("shop_id"), [F.asc("shop_id")], 2, 100).join(F.broadcast(total))


@query("SELECT o_orderpriority AS level, count(*) AS n, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS INTEGER) AS place FROM orders GROUP BY 1")
def o11_category_order(t: Tables):
    levels = t.base("orders").groupBy(F.col("o_orderpriority").alias("level")).agg(F.count("*").alias("n"))
    return levels.withColumn("place", R.category_order(F.col("level"), ["1-URGENT", "2-HIGH"])).orderBy("place", "level")


@query("SELECT name FROM (SELECT DISTINCT p_name AS name FROM part WHERE contains(lower(p_name), 're')) ORDER BY CASE WHEN starts_with(lower(name), 're') THEN 0 ELSE 1 END, name LIMIT 12")
def o14_suggestions(t: Tables):
    return R.suggestions(t.base("part").select(F.col("p_name").alias("name")), "name", "re")


@query("SELECT shop_id FROM b_shop WHERE shop_id NOT IN (SELECT shop_id FROM b_shop ORDER BY shop_id LIMIT 20) ORDER BY shop_id LIMIT 10")
def o15_refill(t: Tables):
    seen = t.shop.select("shop_id").orderBy("shop_id").limit(20)
    return t.shop.select("shop_id").join(seen, "shop_id", "left_anti").orderBy("shop_id").limit(10)


@query("SELECT shop_id, kind, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY shop_id ORDER BY n DESC, kind) AS INTEGER) AS rank FROM (SELECT shop_id, kind, count(*) AS n FROM b_click GROUP BY ALL)) WHERE rank <= 2")
def w03_top_k_per_group(t: Tables):
    return R.top_by(t.click.groupBy("shop_id", "kind").agg(F.count("*").alias("n")), "shop_id", 2, [F.desc("n"), F.asc("kind")])


@query("SELECT shop_id, CAST(min(b) AS INTEGER) AS branch FROM (SELECT shop_id, 0 AS b FROM b_view UNION ALL SELECT shop_id, 1 FROM b_click UNION ALL SELECT shop_id, 2 FROM b_report) GROUP BY 1")
def u01_prioritised_union(t: Tables):
    return R.union_ranked([t.view, t.click, t.report], "shop_id")


@query("SELECT shop_id FROM b_shop WHERE on_hold OR smoking_type = 3")
def u02_or_of_predicates(t: Tables):
    return t.shop.filter(F.col("on_hold") | (F.col("smoking_type") == 3)).select("shop_id")


@query("SELECT DISTINCT genre, area FROM b_shop")
def u04_distinct(t: Tables):
    return t.shop.select("genre", "area").distinct()


@query("SELECT shop_id FROM b_shop WHERE shop_id NOT IN (SELECT shop_id FROM b_report WHERE reason = '1-URGENT')")
def u06_subtract(t: Tables):
    return t.shop.select("shop_id").join(t.report.filter("reason = '1-URGENT'").select("shop_id"), "shop_id", "left_anti")


@query("SELECT shop_id, CASE WHEN last_confirmed_on IS NULL THEN 0 ELSE CAST(strftime(last_confirmed_on, '%Y%m%d') AS INTEGER) END AS day_key FROM b_shop")
def p07_sort_key(t: Tables):
    return t.shop.select("shop_id", F.coalesce(F.date_format("last_confirmed_on", "yyyyMMdd").cast("int"), F.lit(0)).alias("day_key"))


@query("SELECT shop_id, coalesce(nullif(CASE WHEN shop_id % 3 = 0 THEN '' ELSE name END, ''), area) AS name FROM b_shop")
def p08_fill_blank(t: Tables):
    target = t.shop.select("shop_id", F.when(F.col("shop_id") % 3 == 0, "").otherwise(F.col("name")).alias("name"))
    return M.fill_blank(target, t.shop.select("shop_id", F.col("area").alias("name")), "shop_id", ["name"])


@query("SELECT shop_id, CASE WHEN shop_id % 4 = 0 THEN genre ELSE name END AS name FROM b_shop")
def p09_overlay(t: Tables):
    proposed = t.shop.filter("shop_id % 4 = 0").select("shop_id", F.col("genre").alias("name")).unionByName(t.shop.filter("shop_id % 4 = 1").select("shop_id", F.lit(" ").alias("name")))
    return M.overlay(t.shop.select("shop_id", "name"), proposed, "shop_id", ["name"])


@query("SELECT shop_id, CASE WHEN shop_id % 2 = 0 THEN name WHEN shop_id % 3 = 0 THEN genre ELSE area END AS url, CASE WHEN shop_id % 2 = 0 THEN 'first' WHEN shop_id % 3 = 0 THEN 'second' ELSE 'third' END AS label FROM b_shop")
def p11_first_link(t: Tables):
    link = M.first_link([("first", F.when(F.col("shop_id") % 2 == 0, F.col("name"))), ("second", F.when(F.col("shop_id") % 3 == 0, F.col("genre")).otherwise(" ")), ("third", F.col("area"))])
    return t.shop.select("shop_id", link.alias("l")).select("shop_id", "l.url", "l.label")


@query("SELECT shop_id, CASE WHEN shop_id % 5 = 0 THEN upper(area) ELSE name END AS name FROM b_shop")
def k03_upsert(t: Tables):
    new = t.shop.filter("shop_id % 5 = 0").select("shop_id", F.upper("area").alias("name"))
    return M.upsert(t.shop.select("shop_id", "name"), new, ["shop_id"])


@query("SELECT shop_id, CAST(round(0.8e0 / 111.32e0 * 1000000) AS BIGINT) AS half_lat, CAST(round(0.8e0 / 111.32e0 / cos(radians(lat)) * 1000000) AS BIGINT) AS half_lon FROM b_shop")
def m03_extent(t: Tables):
    half, wide = extent(F.col("lat"), F.lit(800.0))
    return t.shop.select("shop_id", F.round(half * 1000000).cast("long").alias("half_lat"), F.round(wide * 1000000).cast("long").alias("half_lon"))


@query(f"SELECT shop_id, {_D.format(b='34.7e0', c='135.5e0')} AS metres FROM b_shop")
def m01_haversine(t: Tables):
    return t.shop.select("shop_id", F.round(haversine_m(F.lit(34.7), F.lit(135.5), F.col("lat"), F.col("lon"))).cast("long").alias("metres"))


@query("SELECT shop_id, CAST(greatest(1, floor(shop_id % 70 / 10.0e0 * 12 + 0.5e0)) AS INTEGER) AS minutes FROM b_shop")
def m04_walking_minutes(t: Tables):
    return t.shop.select("shop_id", walking_minutes(F.col("shop_id") % 70 / F.lit(10.0)).alias("minutes"))


@query("SELECT p_partkey, string_split(p_name, ' ') AS items FROM part")
def t23_list_items(t: Tables):
    return t.base("part").select("p_partkey", list_items(F.col("p_name"), " ").alias("items"))
