"""Search demand: rollups, scores and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeworks.functions import scores as S
from placeworks.functions.geo import half_up
from placeworks.functions.text import first_rule
from placeworks.operators import ranking as R
from placeworks.operators.predicates import approved
from placeworks.operators.supply import cube_of, with_level
from placeworks.plans.registry import query
from placeworks.plans.roles import Tables

THEMES = [("date", "green|azure"), ("shisha", "blue"), ("private", "red"), ("bar", "brown|steel"), ("pub", "copper|tin")]
_THEME = "CASE WHEN regexp_matches(lower({q}), 'green|azure') THEN 'date' WHEN regexp_matches(lower({q}), 'blue') THEN 'shisha' WHEN regexp_matches(lower({q}), 'red') THEN 'private' WHEN regexp_matches(lower({q}), 'brown|steel') THEN 'bar' WHEN regexp_matches(lower({q}), 'copper|tin') THEN 'pub' END"
_INTENT = "CASE WHEN page LIKE '%1' THEN 'high' WHEN page LIKE '%2' THEN 'medium' WHEN page LIKE '%3' THEN 'low' ELSE 'unknown' END"
_POS = "CASE WHEN pos BETWEEN 1 AND 3 THEN 0.6e0 WHEN pos BETWEEN 4 AND 7 THEN 1.0e0 WHEN pos BETWEEN 8 AND 20 THEN 1.6e0 WHEN pos BETWEEN 21 AND 50 THEN 1.2e0 ELSE 0.7e0 END"
_CTR = "CASE WHEN ctr >= 0 AND ctr < 1 THEN 1.6e0 WHEN ctr >= 1 AND ctr < 3 THEN 1.3e0 WHEN ctr >= 3 AND ctr < 8 THEN 1.0e0 ELSE 0.7e0 END"
_INT = "CASE intent WHEN 'high' THEN 1.4e0 WHEN 'medium' THEN 1.15e0 WHEN 'low' THEN 0.7e0 ELSE 1.0e0 END"
_LOG = f"SELECT query, page, pos, impressions, clicks, clicks * 100.0e0 / impressions AS ctr, {_INTENT} AS intent, {_THEME.format(q='query')} AS theme FROM b_querylog WHERE impressions > 0"
_H = "floor(({x}) * 10 + 0.5e0) / 10.0e0"
_IMPACT = _H.format(x=f"""impressions * CASE WHEN pos BETWEEN 1 AND 3 THEN 0.8e0 WHEN pos BETWEEN 4 AND 10 THEN 1.6e0 WHEN pos BETWEEN 11 AND 20 THEN 2.0e0 WHEN pos BETWEEN 21 AND 50 THEN 1.4e0 ELSE 0.8e0 END
* CASE WHEN ctr < 1 THEN 2.0e0 WHEN ctr < 3 THEN 1.6e0 WHEN ctr < 8 THEN 1.2e0 ELSE 0.8e0 END * CASE WHEN supply <= 20 THEN 2.0e0 WHEN supply <= 60 THEN 1.5e0 ELSE 1.0e0 END * 1.5e0 * {_INT}""")
_ACTION = "CASE WHEN pos BETWEEN 8 AND 20 AND impressions >= 30 THEN 'near win' WHEN pos <= 10 AND ctr < 1.5 THEN 'ctr' WHEN shops <= 15 THEN 'shops' WHEN articles <= 1 THEN 'article' WHEN clicks > 0 AND pos < 15 THEN 'links' ELSE 'maintain' END"
_COST = "CASE action WHEN 'ctr' THEN 1.0e0 WHEN 'near win' THEN 1.2e0 WHEN 'links' THEN 1.5e0 WHEN 'article' THEN 3.0e0 WHEN 'shops' THEN 5.0e0 ELSE 2.0e0 END"


def _log(t: Tables):
    page = F.col("page")
    intent = F.when(page.endswith("1"), "high").when(page.endswith("2"), "medium").when(page.endswith("3"), "low").otherwise("unknown")
    rows = t.querylog.filter("impressions > 0").withColumn("ctr", F.col("clicks") * 100.0 / F.col("impressions"))
    return rows.withColumn("intent", intent).withColumn("theme", first_rule(F.col("query"), THEMES))


@query("""SELECT query, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, count(*) AS pages, CAST(floor(CAST(sum(pos) AS DOUBLE) / count(*) * 100 + 0.5e0) AS BIGINT) AS position_x100 FROM b_querylog GROUP BY 1""")
def q20_query_rollup(t: Tables):
    """Sums by query, and the position's mean over pages, not weighted by impressions."""
    mean = F.floor(F.sum("pos").cast("double") / F.count("*") * 100 + 0.5).cast("long")
    return t.querylog.groupBy("query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.count("*").alias("pages"), mean.alias("position_x100"))


@query(f"""WITH l AS ({_LOG}), n AS (SELECT (SELECT count(*) FROM b_shop WHERE approved AND NOT on_hold) % 50 AS shops, (SELECT count(*) FROM b_article WHERE published) % 3 AS articles),
s AS (SELECT l.*, shops, articles, greatest(shops + articles * 20, 5) AS supply FROM l, n), x AS (SELECT *, {_IMPACT} AS expected, {_ACTION} AS action FROM s),
y AS (SELECT *, {_H.format(x='expected / (' + _COST + ')')} AS roi, (expected + clicks * 1.8e0) * CASE theme WHEN 'date' THEN 1.7e0 WHEN 'shisha' THEN 1.8e0 WHEN 'private' THEN 1.35e0 WHEN 'bar' THEN 1.3e0 WHEN 'night' THEN 1.25e0 WHEN 'pub' THEN 1.1e0 WHEN 'smoking area' THEN 0.45e0 ELSE 1.0e0 END AS total FROM x)
SELECT query, page, theme, intent, action, expected, roi, CAST(floor(total * 10 + 0.5e0) AS BIGINT) AS total_x10 FROM y ORDER BY roi DESC, expected DESC, query, page LIMIT 200""")
def q21_search_demand(t: Tables):
    """Every row of the query log scored against supply, the best 200 by return. Supply is one row, joined once."""
    shops = approved(t.shop).agg((F.count("*") % 50).alias("shops"))
    articles = t.article.filter("published").agg((F.count("*") % 3).alias("articles"))
    rows = _log(t).join(F.broadcast(shops.join(articles)))
    c = F.col
    rows = rows.withColumn("supply", S.supply(c("shops"), F.lit(0), c("articles")))
    rows = rows.withColumn("expected", S.expected_impact(c("impressions"), c("pos"), c("ctr"), c("supply"), F.lit(1.5), c("intent")))
    rows = rows.withColumn("action", S.action(c("pos"), c("impressions"), c("ctr"), c("shops"), c("articles"), c("clicks"), c("pos")))
    rows = rows.withColumn("roi", S.roi(c("expected"), c("action"))).withColumn("total", S.total_opportunity(c("expected"), c("clicks").cast("double"), c("theme")))
    best = R.top(rows, 200, "roi desc", "expected desc", "query", "page")
    return best.select("query", "page", "theme", "intent", "action", "expected", "roi", F.floor(c("total") * 10 + 0.5).cast("long").alias("total_x10"))


_WANTED = "SELECT p_partkey, n_name AS area, CASE WHEN p_partkey % 9 < 7 THEN 'd' || CAST(p_partkey % 9 AS VARCHAR) END AS local_area, CASE p_size % 7 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' WHEN 4 THEN 'MACHINERY' END AS genre FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 30"


@query(f"""WITH w AS ({_WANTED}), s AS (SELECT shop_id, area, genre, 'd' || CAST(shop_id % 7 AS VARCHAR) AS local_area, last_confirmed_on IS NOT NULL AS confirmed FROM b_shop WHERE approved AND NOT on_hold)
SELECT p_partkey, w.area, w.local_area, w.genre, count(shop_id) AS shops, count(shop_id) FILTER (WHERE confirmed) AS confirmed, greatest(count(shop_id) + 2 * count(shop_id) FILTER (WHERE confirmed), 5) AS supply
FROM w LEFT JOIN s ON (w.area IS NULL OR w.area = s.area) AND (w.local_area IS NULL OR w.local_area = s.local_area) AND (w.genre IS NULL OR w.genre = s.genre) GROUP BY ALL""")
def q21_supply_levels(t: Tables):
    """Supply of each row of demand at its own keys: area, local area and genre, any of which it may leave open. All levels come from one cube."""
    k, keys = F.col("p_partkey"), ["area", "local_area", "genre"]
    genres = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    named = t.base("nation").select(F.col("n_nationkey").alias("_n"), F.col("n_name").alias("area"))
    wanted = t.base("part").select(k, (k % 30).alias("_n"), F.when(k % 9 < 7, F.concat(F.lit("d"), (k % 9).cast("string"))).alias("local_area"), F.get(genres, (F.col("p_size") % 7).cast("int")).alias("genre")).join(named, "_n", "left")
    shops = approved(t.shop).withColumn("local_area", F.concat(F.lit("d"), (F.col("shop_id") % 7).cast("string")))
    cube = cube_of(shops, keys, shops=F.count("*"), confirmed=F.count("last_confirmed_on"))
    found = with_level(wanted, cube, keys, ["shops", "confirmed"])
    return found.select("p_partkey", *keys, "shops", "confirmed", S.supply(F.col("shops"), F.col("confirmed"), F.lit(0)).alias("supply"))


@query(f"""WITH l AS ({_LOG}) SELECT coalesce(theme, 'none') AS theme, count(*) AS pages, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks,
list(page ORDER BY impressions DESC, page)[1:5] AS best FROM l GROUP BY 1""")
def q22_theme_summary(t: Tables):
    """Measures by theme with its five largest pages (A08): ranks are cut first, so lists stay short."""
    rows = _log(t).withColumn("theme", F.coalesce("theme", F.lit("none")))
    first = R.top_by(rows, "theme", 5, [F.desc("impressions"), F.asc("page")])
    lists = first.groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page"))), lambda x: x["page"]).alias("best"))
    return rows.groupBy("theme").agg(F.count("*").alias("pages"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")).join(lists, "theme")


@query("SELECT area, count(*) AS shops, count(*) FILTER (WHERE approved AND NOT on_hold) AS public FROM b_shop GROUP BY 1")
def q23_area_supply(t: Tables):
    return t.shop.groupBy("area").agg(F.count("*").alias("shops"), F.count_if(F.col("approved") & ~F.col("on_hold")).alias("public"))


@query(f"SELECT DISTINCT query, {_THEME.format(q='query')} AS theme FROM b_querylog")
def c02_theme(t: Tables):
    return t.querylog.select("query", first_rule(F.col("query"), THEMES).alias("theme")).distinct()


@query(f"WITH l AS ({_LOG}) SELECT query, page, {_POS} AS by_position, {_CTR} AS by_ctr, {_INT} AS by_intent FROM l")
def c07_multipliers(t: Tables):
    """Bands of position and rate, labels of intent."""
    return _log(t).select("query", "page", S.position_multiplier(F.col("pos")).alias("by_position"), S.ctr_multiplier(F.col("ctr")).alias("by_ctr"), S.intent_multiplier(F.col("intent")).alias("by_intent"))


@query(f"""WITH l AS ({_LOG}) SELECT query, page, CASE WHEN impressions <= 0 AND clicks <= 0 AND pos <= 0 THEN 0.0e0 ELSE floor((impressions + clicks * 3 + CASE WHEN clicks > 0 THEN CAST(pos AS DOUBLE) / clicks ELSE CAST(pos AS DOUBLE) END * 5
+ CASE WHEN pos < 10 THEN 0.5e0 WHEN pos < 30 THEN 1.0e0 WHEN pos < 90 THEN 1.5e0 ELSE 2.0e0 END * 20) * CASE theme WHEN 'shisha' THEN 1.6e0 WHEN 'date' THEN 1.5e0 WHEN 'private' THEN 1.25e0 WHEN 'bar' THEN 1.2e0 ELSE 1.0e0 END * 10 + 0.5e0) / 10.0e0 END AS value FROM l""")
def c10_page_value(t: Tables):
    return _log(t).select("query", "page", S.page_value(F.col("impressions"), F.col("clicks"), F.col("pos"), F.col("pos"), F.col("theme")).alias("value"))


@query(f"WITH l AS (SELECT *, 40 AS supply FROM ({_LOG})) SELECT query, page, {_IMPACT} AS expected FROM l")
def c13_expected_impact(t: Tables):
    c = F.col
    return _log(t).select("query", "page", S.expected_impact(c("impressions"), c("pos"), c("ctr"), F.lit(40), F.lit(1.5), c("intent")).alias("expected"))


@query("SELECT area, greatest(count(*) + 2 * count(*) FILTER (WHERE last_confirmed_on IS NOT NULL) + 0, 5) AS supply FROM b_shop GROUP BY 1")
def c14_supply(t: Tables):
    return t.shop.groupBy("area").agg(S.supply(F.count("*"), F.count("last_confirmed_on"), F.lit(0)).alias("supply"))


@query(f"WITH l AS (SELECT *, 40 AS shops, 2 AS articles FROM ({_LOG})), x AS (SELECT *, {_ACTION} AS action FROM l) SELECT query, page, action, {_COST} AS cost FROM x")
def c16_action(t: Tables):
    c = F.col
    act = S.action(c("pos"), c("impressions"), c("ctr"), F.lit(40), F.lit(2), c("clicks"), c("pos"))
    return _log(t).withColumn("action", act).select("query", "page", "action", S.work_cost(c("action")).alias("cost"))


@query(f"""WITH l AS (SELECT *, CAST(pos * 2 AS INTEGER) AS relevance FROM ({_LOG})), x AS (SELECT *, CASE WHEN page LIKE '%9' THEN 'none' WHEN page LIKE '%1' AND relevance >= 70 AND pos <= 15 AND ctr < 2 THEN 'improve' WHEN intent = 'low' AND relevance < 70 THEN 'local'
WHEN theme IS NOT NULL AND relevance < 70 THEN 'theme' WHEN page LIKE '%1' AND relevance >= 70 THEN 'improve' ELSE 'new' END AS strategy FROM l)
SELECT query, page, strategy, floor((pos * 0.45e0 + clicks * 0.35e0 + impressions * 0.2e0) * (CASE intent WHEN 'high' THEN 1.35e0 WHEN 'medium' THEN 1.15e0 ELSE 1.0e0 END * CASE strategy WHEN 'improve' THEN 1.25e0 WHEN 'local' THEN 1.2e0 WHEN 'theme' THEN 1.15e0 ELSE 1.0e0 END) * 10 + 0.5e0) / 10.0e0 AS next_move FROM x""")
def c18_next_move(t: Tables):
    """Strategy (C19) and the score of the next move."""
    c = F.col
    landing = c("page").endswith("1")
    strategy = S.strategy(~c("page").endswith("9"), F.lit(False), c("pos") * 2, landing, c("pos"), c("ctr"), F.lit(1), c("intent") == "low", c("theme").isNotNull())
    return _log(t).withColumn("strategy", strategy).select("query", "page", "strategy", S.next_move(c("pos"), c("clicks"), c("impressions"), c("intent"), c("strategy")).alias("next_move"))


@query(f"""WITH l AS ({_LOG}) SELECT query, page, CASE WHEN page LIKE '%1' AND ctr < 2 THEN 'improve ctr' WHEN page LIKE '%2' THEN 'new article' WHEN impressions >= 100 AND theme IS NOT NULL THEN 'circulation' WHEN clicks < 10 AND pos > 0 THEN 'confirm shops' ELSE 'maintain' END AS move FROM l""")
def c20_next_move_type(t: Tables):
    c = F.col
    strategy = F.when(c("page").endswith("1"), "improve").when(c("page").endswith("2"), "local").otherwise("none")
    return _log(t).select("query", "page", S.next_move_type(strategy, c("ctr"), c("impressions"), c("theme").isNotNull(), c("clicks"), c("pos"), F.lit("maintain")).alias("move"))


@query("""WITH q AS (SELECT DISTINCT query FROM b_querylog), w AS (SELECT DISTINCT query, lower(w) AS word FROM (SELECT query, unnest(string_split(query, ' ')) AS w FROM q) WHERE length(w) > 1),
a AS (SELECT p_partkey AS article, lower(p_name) AS title FROM part), tw AS (SELECT DISTINCT article, unnest(string_split(title, ' ')) AS word FROM a)
SELECT query, arg_max(article, (score, -article)) AS article, max(score) AS score FROM (SELECT query, article, count(*) * 5 AS score FROM w JOIN tw USING (word) GROUP BY ALL) GROUP BY 1""")
def c21_article_relevance(t: Tables):
    """Best article for each query by shared words: an equality join on words, not queries times articles. Articles of one title score
    alike, so the smallest stands for them."""
    from placeworks.operators.joins import best_match

    word = lambda df, key, c: df.select(key, F.explode(F.array_distinct(F.split(F.lower(c), " "))).alias("word"))
    words = word(t.querylog.select("query").distinct(), "query", "query").filter(F.length("word") > 1)
    first = t.base("part").groupBy("p_name").agg(F.min("p_partkey").alias("article"))
    hits = words.join(word(first, "article", "p_name"), "word").groupBy("query", "article").agg(F.count("*").alias("n"))
    return best_match(hits.withColumn("score", S.article_relevance(F.lit(False), F.lit(False), F.lit(False), F.lit(False), F.col("n"))), "query", "score", "article")


@query(f"WITH l AS ({_LOG}), x AS (SELECT query, CAST(sum(clicks) AS BIGINT) AS clicks FROM l GROUP BY 1) SELECT query, clicks FROM x ORDER BY clicks DESC, query LIMIT 20")
def o12_report_section(t: Tables):
    return R.top(_log(t).groupBy("query").agg(F.sum("clicks").alias("clicks")), 20, "clicks desc", "query")


@query("""SELECT query, page, CASE WHEN starts_with(page, '/p/1') THEN 'one' ELSE 'other' END AS kind, floor((impressions * 1.0e0 / pos) * 10 + 0.5e0) / 10.0e0 AS density FROM b_querylog""")
def m07_rounding(t: Tables):
    return t.querylog.select("query", "page", F.when(F.col("page").startswith("/p/1"), "one").otherwise("other").alias("kind"), half_up(F.col("impressions") * 1.0 / F.col("pos")).alias("density"))
