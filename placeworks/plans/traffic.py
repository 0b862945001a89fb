"""Views and clicks: reports of traffic."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeworks.functions.geo import half_up, rate
from placeworks.functions.scores import badge, freshness, freshness_band
from placeworks.operators import ranking as R
from placeworks.operators.joins import with_counts
from placeworks.operators.predicates import since
from placeworks.plans.registry import query
from placeworks.plans.roles import Tables, now, today
from placeworks.streaming import first_visits_batch

KINDS = ["phone_click", "map_click", "affiliate_click", "article_shop_click"]
_LAST7 = "created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY"
_RATE = "CASE WHEN {d} > 0 THEN floor({n} * 100.0e0 / {d} * 10 + 0.5e0) / 10.0e0 ELSE 0.0e0 END"


@query("SELECT s.shop_id, name, count(*) AS views FROM b_view v JOIN b_shop s ON v.shop_id = s.shop_id GROUP BY ALL ORDER BY views DESC, s.shop_id LIMIT 50")
def q08_views_by_shop(t: Tables):
    """The most viewed shops. Views are counted before the join, so one row a shop is joined."""
    views = t.view.groupBy("shop_id").agg(F.count("*").alias("views"))
    return R.top(t.shop.join(views, "shop_id").select("shop_id", "name", "views"), 50, "views desc", "shop_id")


@query(f"SELECT CAST(created_at AS DATE) AS day, count(*) AS views FROM b_view WHERE {_LAST7} GROUP BY 1")
def q09_daily_views(t: Tables):
    return t.view.filter(since(F.col("created_at"), now(), 7)).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("views"))


@query("""SELECT a.article_id, title, count(*) AS clicks, count(DISTINCT shop_id) AS shops FROM b_click c JOIN b_article a ON c.article_id = a.article_id
WHERE kind = 'article_shop_click' GROUP BY ALL ORDER BY clicks DESC, a.article_id LIMIT 30""")
def q10_article_ranking(t: Tables):
    clicks = t.click.filter("kind = 'article_shop_click'").groupBy("article_id").agg(F.count("*").alias("clicks"), F.countDistinct("shop_id").alias("shops"))
    return R.top(t.article.join(clicks, "article_id").select("article_id", "title", "clicks", "shops"), 30, "clicks desc", "article_id")


@query("""WITH d AS (SELECT article_id, shop_id, count(*) AS clicks FROM b_click WHERE article_id IS NOT NULL GROUP BY ALL),
acts AS (SELECT shop_id, count(*) FILTER (WHERE kind = 'phone_click') AS phone_click, count(*) FILTER (WHERE kind = 'map_click') AS map_click,
count(*) FILTER (WHERE kind = 'affiliate_click') AS affiliate_click FROM b_click GROUP BY shop_id)
SELECT article_id, d.shop_id, clicks, rank, phone_click, map_click, affiliate_click FROM (SELECT *, CAST(row_number() OVER (PARTITION BY article_id ORDER BY clicks DESC, shop_id) AS INTEGER) AS rank FROM d) d
JOIN acts USING (shop_id) WHERE rank <= 5""")
def q11_article_destinations(t: Tables):
    to = t.click.filter("article_id is not null").groupBy("article_id", "shop_id").agg(F.count("*").alias("clicks"))
    first = R.top_by(to, "article_id", 5, [F.desc("clicks"), F.asc("shop_id")])
    return first.join(R.count_kinds(t.click, ["shop_id"], "kind", KINDS[:3]), "shop_id")


@query(f"""WITH d AS (SELECT DISTINCT article_id, shop_id FROM b_click WHERE article_id IS NOT NULL),
a AS (SELECT shop_id, count(*) AS n FROM b_click WHERE kind = 'affiliate_click' GROUP BY 1),
c AS (SELECT article_id, count(*) AS clicks FROM b_click WHERE article_id IS NOT NULL GROUP BY 1)
SELECT article_id, clicks, affiliate, {_RATE.format(n="affiliate", d="clicks")} AS rate FROM (SELECT c.article_id, clicks, CAST(coalesce(sum(n), 0) AS BIGINT) AS affiliate
FROM c JOIN d USING (article_id) LEFT JOIN a USING (shop_id) GROUP BY ALL)""")
def q12_article_affiliate_rate(t: Tables):
    """Affiliate clicks of all destinations of an article over its clicks; it may exceed 100 %."""
    clicks = t.click.filter("article_id is not null").groupBy("article_id").agg(F.count("*").alias("clicks"))
    affiliate = t.click.filter("kind = 'affiliate_click'").groupBy("shop_id").agg(F.count("*").alias("n"))
    to = t.click.filter("article_id is not null").select("article_id", "shop_id").distinct().join(affiliate, "shop_id", "left")
    sums = to.groupBy("article_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("affiliate"))
    return clicks.join(sums, "article_id").withColumn("rate", rate(F.col("affiliate"), F.col("clicks")))


@query(f"""WITH v AS (SELECT visitor AS article_id, count(*) AS views FROM b_view WHERE visitor < 40 GROUP BY 1),
c AS (SELECT article_id, count(*) AS clicks FROM b_click WHERE article_id IS NOT NULL GROUP BY 1)
SELECT * FROM (SELECT v.article_id, views, coalesce(clicks, 0) AS clicks, {_RATE.format(n="coalesce(clicks, 0)", d="views")} AS rate FROM v LEFT JOIN c USING (article_id))
WHERE views >= 20 AND rate < 90.0e0 ORDER BY rate, article_id LIMIT 10""")
def q13_improvement_candidates(t: Tables):
    """Articles with enough views and few clicks (article views are an input; bound to visitors here)."""
    views = t.view.filter("visitor < 40").groupBy(F.col("visitor").alias("article_id")).agg(F.count("*").alias("views"))
    rows = with_counts(views, t.click.filter("article_id is not null"), "article_id", "clicks").withColumn("rate", rate(F.col("clicks"), F.col("views")))
    return R.top(rows.filter((F.col("views") >= 20) & (F.col("rate") < 90)), 10, "rate", "article_id")


@query(f"""WITH k AS (SELECT shop_id, count(*) FILTER (WHERE kind = 'phone_click') AS phone_click, count(*) FILTER (WHERE kind = 'map_click') AS map_click,
count(*) FILTER (WHERE kind = 'affiliate_click') AS affiliate_click, count(*) FILTER (WHERE kind = 'article_shop_click') AS article_shop_click, count(*) AS total FROM b_click GROUP BY 1),
v AS (SELECT shop_id, count(*) AS views FROM b_view GROUP BY 1)
SELECT s.shop_id, name, coalesce(phone_click, 0) AS phone_click, coalesce(map_click, 0) AS map_click, coalesce(affiliate_click, 0) AS affiliate_click, coalesce(article_shop_click, 0) AS article_shop_click,
coalesce(total, 0) AS total, coalesce(views, 0) AS views, {_RATE.format(n="coalesce(total, 0)", d="coalesce(views, 0)")} AS flow_rate
FROM b_shop s LEFT JOIN k USING (shop_id) LEFT JOIN v USING (shop_id) ORDER BY total DESC, s.shop_id LIMIT 50 OFFSET 50""")
def q14_click_table(t: Tables):
    kinds = R.count_kinds(t.click, ["shop_id"], "kind", KINDS).withColumn("total", sum(F.col(k) for k in KINDS))
    rows = with_counts(t.shop.select("shop_id", "name").join(kinds, "shop_id", "left").fillna(0, [*KINDS, "total"]), t.view, "shop_id", "views")
    return R.page(rows.withColumn("flow_rate", rate(F.col("total"), F.col("views"))), [F.desc("total"), F.asc("shop_id")], 2, 50)


@query("""SELECT s.shop_id, on_hold, coalesce(v.n, 0) AS views FROM b_shop s LEFT JOIN (SELECT shop_id, count(*) AS n FROM b_view WHERE NOT is_bot GROUP BY 1) v USING (shop_id)
WHERE NOT approved OR on_hold ORDER BY views DESC, s.shop_id LIMIT 40""")
def q15_admin_queue(t: Tables):
    waiting = t.shop.filter(~F.col("approved") | F.col("on_hold")).select("shop_id", "on_hold")
    return R.top(with_counts(waiting, t.view.filter(~F.col("is_bot")), "shop_id", "views"), 40, "views desc", "shop_id")


@query("""SELECT s.shop_id, coalesce(c.n, 0) AS clicks FROM b_shop s LEFT JOIN (SELECT shop_id, count(*) AS n FROM b_click GROUP BY 1) c USING (shop_id)
WHERE smoking_type = 3 ORDER BY clicks DESC, s.shop_id LIMIT 30""")
def q16_unverified_queue(t: Tables):
    return R.top(with_counts(t.shop.filter("smoking_type = 3").select("shop_id"), t.click, "shop_id", "clicks"), 30, "clicks desc", "shop_id")


@query("""SELECT s.shop_id, coalesce(v.n, 0) AS views FROM b_shop s LEFT JOIN (SELECT shop_id, count(*) AS n FROM b_view GROUP BY 1) v USING (shop_id)
WHERE approved AND NOT on_hold AND NOT EXISTS (SELECT 1 FROM b_report r WHERE r.shop_id = s.shop_id AND status = 'P') ORDER BY views DESC, s.shop_id LIMIT 100""")
def q17_sub_admin_queue(t: Tables):
    free = t.shop.filter("approved and not on_hold").select("shop_id").join(t.report.filter("status = 'P'"), "shop_id", "left_anti")
    return R.top(with_counts(free, t.view, "shop_id", "views"), 100, "views desc", "shop_id")


@query("""SELECT (SELECT count(*) FROM b_shop WHERE NOT approved) AS waiting, (SELECT count(*) FROM b_shop WHERE on_hold) AS held,
(SELECT count(*) FROM b_report WHERE status = 'P') AS reports, (SELECT count(*) FROM b_review WHERE NOT approved) AS reviews,
(SELECT count(*) FROM b_report WHERE status = 'O') + (SELECT count(*) FROM b_review WHERE NOT approved) AS open_items""")
def q18_pending_counts(t: Tables):
    """Five counts in one row: one-row aggregates side by side."""
    shops = t.shop.agg(F.count_if(~F.col("approved")).alias("waiting"), F.count_if("on_hold").alias("held"))
    reports = t.report.agg(F.count_if(F.col("status") == "P").alias("reports"), F.count_if(F.col("status") == "O").alias("_open"))
    reviews = t.review.agg(F.count_if(~F.col("approved")).alias("reviews"))
    return shops.join(reports).join(reviews).withColumn("open_items", F.col("_open") + F.col("reviews")).drop("_open")


_FRESH = """SELECT shop_id, CAST(greatest(least(CASE WHEN last_confirmed_on IS NULL THEN 0 WHEN DATE '2024-01-31' - last_confirmed_on <= 30 THEN 60
WHEN DATE '2024-01-31' - last_confirmed_on <= 90 THEN 45 WHEN DATE '2024-01-31' - last_confirmed_on <= 180 THEN 30 WHEN DATE '2024-01-31' - last_confirmed_on <= 365 THEN 15 ELSE 5 END
+ CASE WHEN approved THEN 20 ELSE 0 END + CASE WHEN shop_id % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN DATE '2024-01-31' - created_on <= 30 THEN 10 ELSE 0 END
- CASE WHEN on_hold THEN 25 ELSE 0 END - CASE WHEN smoking_area = 2 THEN 10 ELSE 0 END - CASE WHEN smoking_type = 3 THEN 10 ELSE 0 END, 100), 0) AS INTEGER) AS score FROM b_shop"""


def _fresh(t: Tables):
    score = freshness(today(), F.col("last_confirmed_on"), F.col("approved"), F.col("shop_id") % 2 == 0, F.col("created_on"), F.col("on_hold"), F.col("smoking_area") == 2, F.col("smoking_type") == 3)
    return t.shop.select("shop_id", score.alias("score"))


@query(f"""WITH f AS ({_FRESH}), k AS (SELECT shop_id, count(*) FILTER (WHERE kind <> 'article_shop_click') AS total, count(*) FILTER (WHERE kind = 'article_shop_click') AS from_articles FROM b_click GROUP BY 1),
v AS (SELECT shop_id, count(*) AS views FROM b_view GROUP BY 1), x AS (SELECT CASE WHEN score BETWEEN 80 AND 100 THEN 'high' WHEN score BETWEEN 50 AND 79 THEN 'middle' WHEN score BETWEEN 1 AND 49 THEN 'low' ELSE 'unknown' END AS band,
coalesce(from_articles, 0) > 0 AS featured, score, coalesce(total, 0) AS total, coalesce(views, 0) AS views FROM f LEFT JOIN k USING (shop_id) LEFT JOIN v USING (shop_id))
SELECT band, featured, count(*) AS shops, CAST(sum(views) AS BIGINT) AS views, CAST(sum(total) AS BIGINT) AS clicks, {_RATE.format(n="sum(total)", d="sum(views)")} AS click_rate,
CAST(floor(CAST(sum(score) AS DOUBLE) / count(*) * 100 + 0.5e0) AS BIGINT) AS mean_score_x100 FROM x GROUP BY ALL""")
def q19_freshness_impact(t: Tables):
    """Traffic by freshness band, featured in articles or not."""
    kinds = t.click.groupBy("shop_id").agg(F.count_if(F.col("kind") != "article_shop_click").alias("total"), F.count_if(F.col("kind") == "article_shop_click").alias("from_articles"))
    rows = with_counts(_fresh(t).join(kinds, "shop_id", "left").fillna(0, ["total", "from_articles"]), t.view, "shop_id", "views")
    groups = rows.groupBy(freshness_band(F.col("score")).alias("band"), (F.col("from_articles") > 0).alias("featured"))
    mean = F.floor(F.sum("score").cast("double") / F.count("*") * 100 + 0.5).cast("long")
    return groups.agg(F.count("*").alias("shops"), F.sum("views").alias("views"), F.sum("total").alias("clicks"), rate(F.sum("total"), F.sum("views")).alias("click_rate"), mean.alias("mean_score_x100"))


@query(f"SELECT shop_id, score, CASE WHEN score BETWEEN 80 AND 100 THEN 'high' WHEN score BETWEEN 50 AND 79 THEN 'middle' WHEN score BETWEEN 1 AND 49 THEN 'low' ELSE 'unknown' END AS band FROM ({_FRESH})")
def c25_freshness(t: Tables):
    return _fresh(t).withColumn("band", freshness_band(F.col("score")))


@query("SELECT shop_id, count(*) AS n, CASE WHEN count(*) >= 100 THEN 100 WHEN count(*) >= 30 THEN 30 WHEN count(*) >= 10 THEN 10 WHEN count(*) >= 5 THEN 5 ELSE 1 END AS badge FROM b_review GROUP BY 1")
def c30_badges(t: Tables):
    return t.review.groupBy("shop_id").agg(F.count("*").alias("n")).withColumn("badge", badge(F.col("n")))


@query("SELECT count(*) AS n FROM b_view WHERE NOT is_bot")
def a01_filtered_count(t: Tables):
    return t.view.filter(~F.col("is_bot")).agg(F.count("*").alias("n"))


@query("SELECT shop_id, count(*) AS n FROM b_click GROUP BY 1")
def a02_count_by_key(t: Tables):
    return t.click.groupBy("shop_id").agg(F.count("*").alias("n"))


@query("SELECT shop_id, kind, count(*) AS n FROM b_click GROUP BY ALL")
def a03_count_by_two_keys(t: Tables):
    return t.click.groupBy("shop_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM b_click GROUP BY 1")
def a04_count_by_day(t: Tables):
    return t.click.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT kind, count(DISTINCT shop_id) AS shops FROM b_click GROUP BY 1")
def a05_distinct_count(t: Tables):
    return t.click.groupBy("kind").agg(F.countDistinct("shop_id").alias("shops"))


@query("""SELECT shop_id, CAST(sum(CASE WHEN approved THEN 1 ELSE 0 END) AS BIGINT) AS approved_reviews, max(CASE WHEN approved THEN rating END) AS best,
CAST(coalesce(sum(CASE WHEN approved THEN rating END), 0) AS BIGINT) AS stars FROM b_review GROUP BY 1""")
def a06_conditional_aggregates(t: Tables):
    ok = F.col("approved")
    return t.review.groupBy("shop_id").agg(F.count_if(ok).alias("approved_reviews"), F.max(F.when(ok, F.col("rating"))).alias("best"), F.coalesce(F.sum(F.when(ok, F.col("rating"))), F.lit(0)).alias("stars"))


@query("""SELECT shop_id, count(*) AS n, list(kind || ':' || CAST(event_id AS VARCHAR) ORDER BY event_id)[1:5] AS first_five FROM b_click GROUP BY 1""")
def a08_first_five_list(t: Tables):
    ordered = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("event_id", "kind"))), 1, 5), lambda x: F.concat(x["kind"], F.lit(":"), x["event_id"].cast("string")))
    return R.top_by(t.click, "shop_id", 5, [F.asc("event_id")]).groupBy("shop_id").agg(ordered.alias("first_five")).join(t.click.groupBy("shop_id").agg(F.count("*").alias("n")), "shop_id")


@query("SELECT shop_id, arg_max(kind, (created_at, event_id)) AS last_kind FROM b_click GROUP BY 1")
def a10_arg_max(t: Tables):
    return t.click.groupBy("shop_id").agg(F.max_by("kind", F.struct("created_at", "event_id")).alias("last_kind"))


@query("SELECT s.shop_id, m.last FROM b_shop s LEFT JOIN (SELECT shop_id, max(created_at) AS last FROM b_click GROUP BY 1) m USING (shop_id)")
def a12_latest_per_key(t: Tables):
    return t.shop.select("shop_id").join(t.click.groupBy("shop_id").agg(F.max("created_at").alias("last")), "shop_id", "left")


@query("SELECT shop_id, CASE WHEN count(*) FILTER (WHERE approved) > 0 THEN floor(CAST(sum(rating) FILTER (WHERE approved) AS DOUBLE) / count(*) FILTER (WHERE approved) * 10 + 0.5e0) / 10.0e0 ELSE 0.0e0 END AS mean FROM b_review GROUP BY 1")
def a14_mean_rating(t: Tables):
    ok = F.col("approved")
    n = F.count_if(ok)
    return t.review.groupBy("shop_id").agg(F.when(n > 0, half_up(F.sum(F.when(ok, F.col("rating"))).cast("double") / n)).otherwise(F.lit(0.0)).alias("mean"))


@query("SELECT kind, count(*) AS n FROM b_click GROUP BY 1")
def a15_tally(t: Tables):
    return t.click.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT area, list(shop_id ORDER BY shop_id) AS shops FROM b_shop GROUP BY 1")
def a16_grouped_lists(t: Tables):
    """All shops of each area, in order. The list is one row by definition; it is put together from sorted pieces of a thousand ids, so no task sorts a whole area."""
    piece = F.floor(F.col("shop_id") / 1000)
    pieces = t.shop.groupBy("area", piece.alias("piece")).agg(F.array_sort(F.collect_list("shop_id")).alias("ids"))
    ordered = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    return pieces.groupBy("area").agg(ordered.alias("p")).select("area", F.flatten(F.transform("p", lambda x: x["ids"])).alias("shops"))


@query("SELECT shop_id, list(smoking_area ORDER BY smoking_area) AS areas FROM (SELECT DISTINCT shop_id, CAST(k % 5 AS INTEGER) AS smoking_area FROM (SELECT shop_id, event_id AS k FROM b_click)) GROUP BY 1")
def a16_code_lists(t: Tables):
    """Lists with a bound of their own: the distinct codes, five at most, of each shop."""
    return t.click.groupBy("shop_id").agg(F.array_sort(F.collect_set((F.col("event_id") % 5).cast("int"))).alias("areas"))


@query("SELECT shop_id, CASE WHEN bool_or(status IN ('F', 'O')) THEN 'approved_or_rejected' WHEN bool_or(status = 'P') THEN 'pending_only' ELSE 'none' END AS outcome FROM b_report GROUP BY 1")
def a17_outcome(t: Tables):
    return t.report.groupBy("shop_id").agg(R.outcome(F.col("status").isin("F", "O"), F.col("status") == "P").alias("outcome"))


@query("SELECT status, reason, count(*) AS n FROM b_report GROUP BY ALL")
def a18_histogram(t: Tables):
    return t.report.groupBy("status", "reason").agg(F.count("*").alias("n"))


@query("SELECT id, count(*) OVER (PARTITION BY name, city) AS same FROM b_record")
def a19_uniqueness(t: Tables):
    """Counts of each identity joined back: a count is combined before the shuffle, a window's rows are not."""
    n = t.record.groupBy("name", "city").agg(F.count("*").alias("same"))
    return t.record.join(n, ["name", "city"]).select("id", "same")


@query("""SELECT event_type, CASE WHEN value < 100 THEN 'fast' WHEN value < 400 THEN 'slow' ELSE 'very slow' END AS speed, count(*) AS n, CAST(max(k) AS INTEGER) AS worst FROM b_event GROUP BY ALL""")
def a22_outcome_tallies(t: Tables):
    v = F.col("value")
    return t.event.groupBy("event_type", F.when(v < 100, "fast").when(v < 400, "slow").otherwise("very slow").alias("speed")).agg(F.count("*").alias("n"), F.max("k").alias("worst"))


@query("""SELECT count(*) FILTER (WHERE kind = 'phone_click') AS phone, count(*) FILTER (WHERE kind = 'map_click') AS map, count(*) FILTER (WHERE article_id IS NOT NULL) AS from_article,
count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-24') AS recent FROM b_click""")
def a23_conditional_counts(t: Tables):
    c = F.col
    return t.click.agg(F.count_if(c("kind") == "phone_click").alias("phone"), F.count_if(c("kind") == "map_click").alias("map"), F.count_if(c("article_id").isNotNull()).alias("from_article"), F.count_if(since(c("created_at"), now(), 7)).alias("recent"))


@query("""SELECT shop_id, count(*) FILTER (WHERE kind = 'phone_click') AS phone_click, count(*) FILTER (WHERE kind = 'map_click') AS map_click, count(*) FILTER (WHERE kind = 'affiliate_click') AS affiliate_click,
count(*) FILTER (WHERE kind = 'article_shop_click') AS article_shop_click FROM b_click GROUP BY 1""")
def p06_pivot(t: Tables):
    return R.count_kinds(t.click, ["shop_id"], "kind", KINDS)


@query("WITH k AS (SELECT kind, count(*) AS n FROM b_click GROUP BY 1) SELECT kind, n, floor(n * 1000.0e0 / (SELECT sum(n) FROM k) + 0.5e0) / 10.0e0 AS share FROM k")
def w06_share_of_total(t: Tables):
    return R.share(t.click.groupBy("kind").agg(F.count("*").alias("n")), "n")


@query("""SELECT shop_id, visitor, CAST(created_at AS DATE) AS day, min(created_at) AS first_at FROM b_view WHERE NOT is_bot GROUP BY ALL""")
def r01_first_visits(t: Tables):
    """One view a shop, visitor and day."""
    first = first_visits_batch(t.view, keys=["shop_id", "visitor", "day"])
    return first.select("shop_id", "visitor", "day", F.col("created_at").alias("first_at"))


@query("SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM b_view GROUP BY 1")
def r05_daily_counts(t: Tables):
    return t.view.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
