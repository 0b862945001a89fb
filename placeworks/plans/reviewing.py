"""Review states, remaining scores and exports (L01-L09, C03-C35, Q07, Q31, E03-E24, I04-I09, K, P, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeworks.functions import hours as H
from placeworks.functions import scores as S
from placeworks.operators import linkage as L
from placeworks.operators import merging as M
from placeworks.operators import predicates as P
from placeworks.operators import ranking as R
from placeworks.operators import review
from placeworks.operators.weekly import projection
from placeworks.plans.registry import query
from placeworks.plans.roles import Tables

_STATES = ["pending", "confirmed", "applied", "excluded", "skipped", "rolled_back", "rollback_conflict"]
_SQL_STATE = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATES)) + " END"


def _state(k):
    return F.element_at(F.array(*[F.lit(s) for s in _STATES]), (k % 7 + 1).cast("int"))


def _matches(t: Tables):
    k = F.col("o_orderkey")
    pick = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    return t.base("orders").select(
        k.alias("match"), F.col("o_custkey").alias("target"), _state(k).alias("state"), pick(2, "bulk", "review").alias("class"), pick(3, "review", "bulk").alias("target_class"), F.when(k % 5 < 3, "pending").otherwise("confirmed").alias("target_state"), (k % 11 != 0).alias("selected"),
        (k % 13 != 0).alias("shop_exists"), (k % 17 != 0).alias("approved"), (k % 19 != 0).alias("unchanged"), (k % 2 == 0).alias("bulk"), (1 + F.when(k % 23 == 0, 1).otherwise(0)).alias("identity_count"), (k % 29 != 0).alias("url_valid"), (k % 31 == 0).alias("url_taken"), (k % 37 == 0).alias("same_url"), (k % 4 == 0).alias("has_url"), (k % 8 == 0).alias("allow_replace"),
        F.when(k % 3 > 0, F.col("o_orderdate")).alias("applied_at"), (k % 10).alias("current"), F.when(k % 6 == 0, -1).otherwise(k % 10).alias("after"), (k % 4).alias("version"), F.when(k % 9 == 0, -1).otherwise(k % 4).alias("applied_version"),
    )


_ELIGIBLE = f"((o_orderkey % 2 = 0 AND {_SQL_STATE} = 'pending' AND o_orderkey % 3 <> 0 AND o_orderkey % 5 < 3) OR ({_SQL_STATE} = 'confirmed' AND o_orderkey % 5 >= 3 AND o_orderkey % 11 <> 0))"


@query(f"SELECT o_orderkey AS match FROM orders WHERE {_ELIGIBLE}")
def l01_eligible(t: Tables):
    return review.eligible(_matches(t)).select("match")


_APPLY = [
    (f"{_SQL_STATE} IN ('applied', 'skipped', 'rollback_conflict', 'rolled_back')", _SQL_STATE, "unchanged"), (f"NOT {_ELIGIBLE}", "'conflict'", "state changed"), ("o_orderkey % 13 = 0", "'conflict'", "shop deleted"), ("o_orderkey % 17 = 0", "'conflict'", "shop not public"), ("o_orderkey % 19 = 0", "'conflict'", "shop changed since matching"),
    ("o_orderkey % 2 = 0 AND o_orderkey % 23 = 0", "'conflict'", "no longer one to one"), ("o_orderkey % 29 = 0", "'conflict'", "URL not valid"), ("o_orderkey % 31 = 0", "'url_conflict'", "URL of another shop"), ("o_orderkey % 37 = 0", "'skipped'", "URL already there"), ("o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0", "'conflict'", "replacement not confirmed"),
]


@query("SELECT o_orderkey AS match, CASE " + " ".join(f"WHEN {w} THEN {s}" for w, s, _ in _APPLY) + " ELSE 'applied' END AS state, CASE " + " ".join(f"WHEN {w} THEN '{r}'" for w, _, r in _APPLY) + " ELSE 'applied' END AS reason FROM orders")
def l02_applied(t: Tables):
    """Each match through the checks in their order; the first that fails names the reason."""
    m = _matches(t)
    return review.applied(m.join(review.eligible(m).select("match", F.lit(True).alias("eligible")), "match", "left").fillna(False, ["eligible"])).select("match", "state", "reason")


@query(f"""SELECT o_orderkey AS match, CASE WHEN NOT ({_SQL_STATE} IN ('applied', 'rollback_conflict') AND o_orderkey % 3 > 0) THEN {_SQL_STATE} WHEN o_orderkey % 13 <> 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 9 <> 0 THEN 'rolled_back' ELSE 'rollback_conflict' END AS state FROM orders""")
def l03_rolled_back(t: Tables):
    return review.rolled_back(_matches(t)).select("match", "state")


_ACTIONS = ["confirm", "exclude", "hold", "restore", "refresh"]
_DECIDED = "WITH d AS (SELECT user_id AS target, arg_max(['confirm', 'exclude', 'hold', 'restore', 'refresh'][1 + event_id % 5], (ts, event_id)) AS action FROM events GROUP BY 1), s AS (SELECT c_custkey AS target, CASE WHEN c_custkey % 2 = 0 THEN 'pending' ELSE 'confirmed' END AS was, action FROM customer LEFT JOIN d ON c_custkey = target), n AS (SELECT target, was, CASE action WHEN 'confirm' THEN 'confirmed' WHEN 'exclude' THEN 'excluded' WHEN 'hold' THEN 'held' WHEN 'restore' THEN 'pending' ELSE was END AS state FROM s)"


def _decided(t: Tables):
    targets = t.base("customer").select(F.col("c_custkey").alias("target"), F.when(F.col("c_custkey") % 2 == 0, "pending").otherwise("confirmed").alias("state"))
    decisions = t.base("events").select(F.col("user_id").alias("target"), F.element_at(F.array(*[F.lit(a) for a in _ACTIONS]), (F.col("event_id") % 5 + 1).cast("int")).alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return targets, review.decided(targets, decisions)


@query(_DECIDED + " SELECT target, state FROM n")
def l04_decided(t: Tables):
    """Latest decision by target: one aggregate, then a join to the targets."""
    return _decided(t)[1]


@query(_DECIDED + """ SELECT target, '{"from":"' || was || '","to":"' || state || '"}' AS payload FROM n WHERE was <> state""")
def l05_audit(t: Tables):
    return review.audit(*_decided(t), "target")


@query("""WITH v AS (SELECT user_id AS shop_id, arg_max({'a': CAST(event_id % 4 AS INTEGER), 'b': CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 3 AS INTEGER) END}, (ts, event_id)) AS s FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT b_shop.shop_id, coalesce(s['a'], smoking_area) AS smoking_area, coalesce(s['b'], smoking_type) AS smoking_type FROM b_shop LEFT JOIN v USING (shop_id)""")
def l08_verified(t: Tables):
    e = F.col("event_id")
    submissions = t.base("events").select(F.col("user_id").alias("shop_id"), F.when(F.col("event_type") == "click", "approved").otherwise("pending").alias("status"), (e % 4).cast("int").alias("area"), F.when(e % 2 == 0, (e % 3).cast("int")).alias("type"), F.col("ts").alias("at"), e.alias("id"))
    return review.verified(t.shop.select("shop_id", "smoking_area", "smoking_type"), submissions)


_REASONS = ["closed", "moved", "non_smoking", "duplicate", "other"]


@query("""WITH r AS (SELECT shop_id, arg_max(['closed', 'moved', 'non_smoking', 'duplicate', 'other'][1 + id % 5], (updated_at, id)) AS reason FROM b_report WHERE status = 'F' GROUP BY 1),
h AS (SELECT b_shop.shop_id, on_hold, CASE reason WHEN 'closed' THEN 'closed' WHEN 'moved' THEN 'moved' WHEN 'non_smoking' THEN 'confirmed non-smoking' WHEN 'duplicate' THEN 'duplicate' END AS why FROM b_shop LEFT JOIN r USING (shop_id))
SELECT shop_id, on_hold OR why IS NOT NULL AS on_hold, coalesce(why, CASE WHEN shop_id % 3 = 0 THEN 'before' END) AS hold_reason FROM h""")
def l09_resolved(t: Tables):
    reports = t.report.select("shop_id", "id", "updated_at", F.when(F.col("status") == "F", "resolved").otherwise("open").alias("status"), F.element_at(F.array(*[F.lit(r) for r in _REASONS]), (F.col("id") % 5 + 1).cast("int")).alias("reason"))
    shops = t.shop.select("shop_id", "on_hold", F.when(F.col("shop_id") % 3 == 0, "before").alias("hold_reason"))
    return review.resolved(shops, reports)


_INTENTS = {"high": ["gadget", "widget"], "medium": ["cold"], "low": ["e"]}


@query("SELECT DISTINCT query, CASE WHEN contains(lower(query), 'gadget') OR contains(lower(query), 'widget') THEN 'high' WHEN contains(lower(query), 'cold') THEN 'medium' WHEN contains(lower(query), 'e') THEN 'low' ELSE 'unknown' END AS intent FROM b_querylog")
def c03_intent(t: Tables):
    return t.querylog.select("query").distinct().select("query", S.intent(F.col("query"), _INTENTS).alias("intent"))


_POS = "CASE WHEN pos BETWEEN 1 AND 3 THEN 0.6e0 WHEN pos BETWEEN 4 AND 7 THEN 1.0e0 WHEN pos BETWEEN 8 AND 20 THEN 1.6e0 WHEN pos BETWEEN 21 AND 50 THEN 1.2e0 ELSE 0.7e0 END"
_CTR = "CASE WHEN ctr >= 0 AND ctr < 1 THEN 1.6e0 WHEN ctr >= 1 AND ctr < 3 THEN 1.3e0 WHEN ctr >= 3 AND ctr < 8 THEN 1.0e0 ELSE 0.7e0 END"


@query(f"""WITH l AS (SELECT *, clicks * 100.0e0 / impressions AS ctr FROM b_querylog WHERE impressions > 0), x AS (SELECT query, page, impressions + clicks * 5 AS demand, {_POS} * {_CTR} AS growth, impressions * {_CTR} AS rate FROM l)
SELECT query, page, demand, CAST(floor(demand * growth * 10 + 0.5e0) AS BIGINT) AS views, CAST(floor(demand * growth * 1.5e0 * 10 + 0.5e0) AS BIGINT) AS revenue, CAST(floor(demand / 40.0e0 * 10 + 0.5e0) AS BIGINT) AS gap, CAST(floor(rate * 10 + 0.5e0) AS BIGINT) AS rate FROM x""")
def c15_component_scores(t: Tables):
    """Scores times ten, rounded half up."""
    c = F.col
    rows = t.querylog.filter("impressions > 0").withColumn("ctr", c("clicks") * 100.0 / c("impressions"))
    s = rows.select("query", "page", S.component_scores(c("impressions"), c("clicks"), c("pos"), c("ctr"), F.lit(1.5), F.lit(40.0)).alias("s"))
    ten = lambda name: F.floor(c(f"s.{name}") * 10 + 0.5).cast("long").alias(name)
    return s.select("query", "page", c("s.demand").cast("long").alias("demand"), *[ten(n) for n in ("views", "revenue", "gap", "rate")])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_size > 4 OR (p_size >= 4 AND a = 'north') OR (a <> 'north') THEN CASE WHEN a = 'north' AND p_size < 4 THEN '/north/bar' ELSE '/a/' || CAST(p_partkey AS VARCHAR) END ELSE '/north/bar' END
WHEN a = 'north' THEN '/north/bar' WHEN a = 'south' THEN '/south' ELSE '' END AS path FROM (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'west' END AS a FROM part) WHERE p_size >= 2 OR a <> 'south'""")
def c22_landing_page(t: Tables):
    """An article's path against the pages of its area and genre; an article's score is its size."""
    k, size = F.col("p_partkey"), F.col("p_size")
    area = F.when(k % 3 == 0, "north").when(k % 3 == 1, "south").otherwise("west")
    path = F.when(k % 4 == 0, F.concat(F.lit("/a/"), k.cast("string")))
    rows = t.base("part").filter((size >= 2) | (area != "south"))
    return rows.select(k, S.landing_page(path, size, area, F.lit("bar"), {"north": "/north", "south": "/south"}, {("north", "bar"): "/north/bar"}).alias("path"))


@query("""SELECT p_partkey, CASE WHEN len(x) > 0 THEN x ELSE ['check existing pages'] END AS items FROM (SELECT p_partkey, list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'improve title, links and lead: position 8 to 20' END, CASE WHEN p_size < 20 AND p_partkey % 3 > 0 THEN 'collect shops: ' || p_brand || ' ' || p_type END,
CASE WHEN p_partkey % 20 < 10 AND p_size > 0 THEN 'confirm known shops' END, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN 'write an article: ' || p_brand || ' ' || p_type END, CASE WHEN p_partkey % 7 < 2 AND p_size >= 30 THEN 'improve title and description' END, CASE WHEN p_partkey % 40 BETWEEN 8 AND 30 THEN 'link from related pages' END], lambda v: v IS NOT NULL) AS x FROM part)""")
def c24_work_items(t: Tables):
    k, size = F.col("p_partkey"), F.col("p_size")
    area = F.when(k % 3 > 0, F.col("p_brand"))
    return t.base("part").select(k, S.work_items(F.when(k % 5 == 0, "near win").otherwise("maintain"), size, k % 20, k % 2, k % 7, size, k % 40, area, F.col("p_type")).alias("items"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'circulation' WHEN 1 THEN 'circulation' WHEN 2 THEN 'circulation' WHEN 3 THEN 'conversion' WHEN 4 THEN 'conversion' ELSE 'search' END AS kind FROM part")
def c35_theme_type(t: Tables):
    theme = F.element_at(F.array(*[F.lit(x) for x in ("date", "shisha", "bar", "private", "night", "pub")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.base("part").select("p_partkey", S.theme_type(theme).alias("kind"))


@query("SELECT area, genre, count(*) AS shops, count(*) FILTER (WHERE last_confirmed_on IS NOT NULL) AS confirmed FROM b_shop WHERE approved AND NOT on_hold GROUP BY ALL")
def c23_supply_by_pair(t: Tables):
    """Shops and confirmed ones of each area and genre, all pairs in one aggregate."""
    return P.approved(t.shop).groupBy("area", "genre").agg(F.count("*").alias("shops"), F.count("last_confirmed_on").alias("confirmed"))


@query("""WITH a AS (SELECT p_partkey AS id, CAST(p_partkey % 25 AS INTEGER) AS area, p_type AS genre, p_size % 3 = 0 AS img FROM part), s AS (SELECT c_custkey AS shop_id, CAST(c_nationkey AS INTEGER) AS area, CASE WHEN c_custkey % 2 = 0 THEN 'ECONOMY' ELSE 'none' END AS genre FROM customer WHERE c_nationkey <> 3 OR c_custkey % 2 = 0),
k AS (SELECT DISTINCT area, genre FROM s), r AS (SELECT k.area, k.genre, id, CASE WHEN a.area = k.area THEN 10 ELSE 0 END + CASE WHEN a.genre = k.genre THEN 6 ELSE 0 END + CASE WHEN img THEN 2 ELSE 0 END AS score FROM k JOIN a ON a.area = k.area OR a.genre = k.genre),
n AS (SELECT *, row_number() OVER (PARTITION BY area, genre ORDER BY score DESC, id DESC) AS rank FROM r) SELECT shop_id, id AS article, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM s JOIN n USING (area, genre) WHERE rank <= 3""")
def q07_related_articles(t: Tables):
    """Three articles for every shop, ranked once for each area and genre."""
    articles = t.base("part").select(F.col("p_partkey").alias("id"), F.array((F.col("p_partkey") % 25).cast("int")).alias("areas"), F.array("p_type").alias("genres"), (F.col("p_size") % 3 == 0).alias("has_image"))
    k = F.col("c_custkey")
    shops = t.base("customer").filter((F.col("c_nationkey") != 3) | (k % 2 == 0)).select(k.alias("shop_id"), F.col("c_nationkey").cast("int").alias("area"), F.when(k % 2 == 0, "ECONOMY").otherwise("none").alias("genre"))
    return R.related(shops, articles)


@query("SELECT DISTINCT regexp_replace(c_name, '[^0-9]', '', 'g') AS normalized_phone FROM customer WHERE c_custkey % 4 > 0")
def q31_phone_export(t: Tables):
    """Distinct digits of all phones that have any; a report sorts them when it is written."""
    raw = F.when(F.col("c_custkey") % 4 > 0, F.concat_ws("-", F.substring("c_name", 1, 12), F.substring("c_name", 13, 20))).otherwise(" - ")
    return t.base("customer").select(F.regexp_replace(raw, "[^0-9]", "").alias("normalized_phone")).filter("normalized_phone != ''").distinct()


@query("SELECT id FROM (SELECT c_custkey AS id FROM customer WHERE starts_with(c_mktsegment, 'B') ORDER BY id LIMIT 100)")
def e03_scope(t: Tables):
    return L.in_scope(t.base("customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), "c_mktsegment", "B", 100).select("id")


@query("""WITH h AS (SELECT p_partkey AS hit, p_partkey % 60 AS target, CASE WHEN p_partkey % 2 = 0 THEN 65 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 35 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 20 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 15 ELSE 0 END + CASE WHEN p_partkey % 11 = 0 THEN 10 ELSE 0 END AS score FROM part)
SELECT target, arg_max(hit, (score, -hit)) AS hit, CAST(max(score) AS INTEGER) AS score FROM h WHERE score >= 30 GROUP BY 1""")
def e17_best_hit(t: Tables):
    k = F.col("p_partkey")
    piece = lambda n, text: F.when(k % n == 0, text).otherwise("-")
    title, snippet = F.concat_ws(" ", piece(2, "Bar Alpha Umeda"), piece(5, "kita")), F.concat_ws(" ", piece(3, "bar alpha umeda"), piece(7, "OSAKA"))
    score = S.hit_score(F.lit("bar alpha umeda"), F.lit("bar alpha"), F.lit("kita"), title, snippet, piece(11, "https://x.example/osaka/1"), ["OSAKA"], "/osaka/")
    return L.best_hit(t.base("part").select((k % 60).alias("target"), k.alias("hit"), score.cast("int").alias("score")))


_KEYS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 101 END AS phone, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 97 END AS name, c_custkey % 89 AS address FROM customer"


def _keyed(t: Tables):
    k = F.col("c_custkey")
    return t.base("customer").select(k.alias("id"), F.when(k % 3 > 0, k % 101).alias("phone"), F.when(k % 4 > 0, k % 97).alias("name"), (k % 89).alias("address"))


@query(f"""WITH c AS ({_KEYS}), o AS (SELECT a.id, (SELECT min(b.id) FROM c b WHERE b.phone = a.phone AND b.id <> a.id) AS x, (SELECT min(b.id) FROM c b WHERE b.name = a.name AND b.id <> a.id) AS y, (SELECT min(b.id) FROM c b WHERE b.address = a.address AND b.id <> a.id) AS z FROM c a)
SELECT id, coalesce(x, y, z) AS other, CASE WHEN x IS NOT NULL THEN 'phone' WHEN y IS NOT NULL THEN 'name' ELSE 'address' END AS key FROM o WHERE coalesce(x, y, z) IS NOT NULL""")
def e22_duplicate_cascade(t: Tables):
    return L.duplicate_cascade(_keyed(t), ["phone", "name", "address"])


@query(f"""WITH c AS ({_KEYS}), p AS (SELECT * FROM c ORDER BY id LIMIT 50) SELECT id, EXISTS (SELECT 1 FROM c WHERE c.id NOT IN (SELECT id FROM p) AND (c.phone = p.phone OR c.name = p.name)) AS duplicate FROM p""")
def e23_page_states(t: Tables):
    """A page of fifty rows against all records outside of it."""
    rows = _keyed(t)
    return L.page_states(rows.orderBy("id").limit(50), rows, ["phone", "name"]).select("id", "duplicate")


@query("""WITH n AS (SELECT c_custkey AS id, 'n' || CAST(c_custkey % 50 AS VARCHAR) AS name, 'street' || CAST(c_custkey AS VARCHAR) AS a FROM customer WHERE c_custkey % 10 = 1), k AS (SELECT p_partkey + 1000000 AS id, 'n' || CAST(p_partkey % 9 AS VARCHAR) AS name, 'street' || CAST(p_partkey * 3 AS VARCHAR) AS a FROM part)
SELECT id FROM n WHERE name IN (SELECT name FROM k) OR EXISTS (SELECT 1 FROM k WHERE contains(n.a, k.a) OR contains(k.a, n.a))""")
def e24_import_duplicates(t: Tables):
    """Rows of an import, which are every tenth customer, against all known records."""
    new = t.base("customer").filter("c_custkey % 10 = 1").select(*_row(F.col("c_custkey"), 50, 1, 0))
    known = t.base("part").select(*_row(F.col("p_partkey"), 9, 3, 1_000_000))
    keyed = lambda df: df.withColumn("address_key", F.col("address"))
    return L.import_duplicates(keyed(new), keyed(known)).select("id")


def _row(k, n, factor, shift):
    return (k + shift).alias("id"), F.concat(F.lit("n"), (k % n).cast("string")).alias("name"), F.concat(F.lit("street"), (k * factor).cast("string")).alias("address")


@query("""SELECT c_custkey AS shop_id, CAST(d AS INTEGER) AS weekday, CAST(r.s AS INTEGER) AS opens, CAST(r.e AS INTEGER) AS closes FROM (SELECT c_custkey, d, unnest(CASE c_custkey % 3 WHEN 0 THEN [{'s': 600, 'e': 900}]
WHEN 1 THEN CASE WHEN d = 1 THEN [{'s': 660, 'e': 840}, {'s': 1020, 'e': 1320}] ELSE [] END ELSE CASE WHEN d IN (1, 2) THEN [{'s': 0, 'e': 60}, {'s': 1080, 'e': 1440}] ELSE [] END END) AS r FROM customer, range(7) t(d))""")
def i04_projection(t: Tables):
    """The three sources of hours: a holiday text holds every day, a schedule without its break, lines of text by weekday (also Q28)."""
    from placeworks.functions.arrays import schedule

    k = F.col("c_custkey") % 3
    plan = schedule(F.when(k == 1, '{"monday":{"closed":false,"open":"11:00","close":"22:00","break_enabled":true,"break_start":"14:00","break_end":"17:00"},"tuesday":{"closed":true}}'))
    shops = t.base("customer").select(F.col("c_custkey").alias("shop_id"), plan.alias("schedule"), F.when(k == 2, "月・火 18:00-01:00").alias("hours_text"), F.when(k == 0, "10:00-15:00").alias("holiday_text"))
    return projection(shops)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 13 = 0 THEN false ELSE CASE c_custkey % 5 WHEN 0 THEN c_custkey % 3 <> 0 WHEN 1 THEN false WHEN 2 THEN c_custkey % 1440 >= 1080 OR c_custkey % 1440 < 60 WHEN 3 THEN c_custkey % 7 <> 0 AND c_custkey % 1440 >= 600 AND c_custkey % 1440 < 700 ELSE c_custkey % 1440 >= 660 AND c_custkey % 1440 < 900 END END AS allowed FROM customer""")
def i07_smoking_now(t: Tables):
    k = F.col("c_custkey")
    text = F.element_at(F.array(F.lit(" "), F.lit("月 喫煙不可\n祝日 10:00-20:00"), F.lit("月 18:00-01:00"), F.lit("月 10:00-11:40\n祝日 未設定"), F.lit("11:00-15:00")), (k % 5 + 1).cast("int"))
    return t.base("customer").select(k, H.smoking_now(k % 2 == 1, k % 13 == 0, k % 3 == 0, text, "月", (k % 5 != 2) & (k % 7 == 0), (k % 1440).cast("int")).alias("allowed"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ['660-840', '1080-1500'] WHEN 1 THEN ['660-870', '1020-1380', '1470-1500'] WHEN 2 THEN ['720-1500'] ELSE ['660-870', '1020-1500'] END AS ranges FROM customer""")
def i09_without_ban(t: Tables):
    """Bans inside both openings, after midnight, over the first opening, and outside of both."""
    k = F.col("c_custkey") % 4
    start, end = F.when(k == 0, 840).when(k == 1, 1380).when(k == 2, 600).otherwise(900), F.when(k == 0, 1080).when(k == 1, 30).when(k == 2, 720).otherwise(1000)
    opens = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((660, 870), (1020, 1500))])
    return t.base("customer").select("c_custkey", F.transform(H.without_ban(opens, start, end), lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))).alias("ranges"))


@query("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AND event_id % 4 <> 0 AND event_id % 4 <> 1 AS filled FROM events")
def f16_filled_json(t: Tables):
    text = F.when(F.col("event_id") % 4 == 0, "{}").when(F.col("event_id") % 4 == 1, " null").otherwise(F.col("props"))
    return t.base("events").select("event_id", P.filled_json(text).alias("filled"))


@query("SELECT * EXCLUDE (c_acctbal, c_name) FROM customer")
def p02_without_columns(t: Tables):
    return t.base("customer").drop("c_acctbal", "c_name")


@query("SELECT DISTINCT p_type FROM part")
def p04_value_list(t: Tables):
    """Values of one column; a caller that needs them on the driver collects a checked number."""
    return t.base("part").select("p_type").distinct()


@query("WITH r AS (SELECT shop_id, CAST(row_number() OVER (ORDER BY n DESC, shop_id) AS INTEGER) AS rank FROM (SELECT shop_id, count(*) AS n FROM b_view GROUP BY 1) ORDER BY rank LIMIT 40) SELECT rank, shop_id, name FROM r JOIN b_shop USING (shop_id)")
def p05_in_rank_order(t: Tables):
    from pyspark.sql.window import Window

    best = R.top(t.view.groupBy("shop_id").agg(F.count("*").alias("n")), 40, "n desc", "shop_id")
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "shop_id")))  # forty rows
    return R.in_rank_order(t.shop.select("shop_id", "name"), ranked, "shop_id").select("rank", "shop_id", "name")


@query("""SELECT c_custkey, '{"c_name":"' || c_name || '","c_nationkey":' || CAST(c_nationkey AS VARCHAR) || '}' AS before FROM customer""")
def p10_snapshot(t: Tables):
    return t.base("customer").select("c_custkey", M.snapshot("c_name", "c_nationkey").alias("before"))


@query("WITH r AS (SELECT o_custkey, o_orderstatus, max(o_orderkey) AS run FROM orders GROUP BY ALL) SELECT event_id, run FROM events LEFT JOIN r ON user_id = o_custkey AND CASE WHEN event_id % 2 = 0 THEN 'F' ELSE 'O' END = o_orderstatus")
def p12_two_keys(t: Tables):
    """Latest run of each shop and provider, looked up by both."""
    runs = t.base("orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("provider")).agg(F.max("o_orderkey").alias("run"))
    return t.base("events").select("event_id", "user_id", F.when(F.col("event_id") % 2 == 0, "F").otherwise("O").alias("provider")).join(runs, ["user_id", "provider"], "left").select("event_id", "run")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 'unknown' ELSE c_mktsegment END AS genre FROM customer")
def k04_set_based_update(t: Tables):
    genre = F.when((F.col("c_acctbal") < 0) & (F.col("c_mktsegment") == "BUILDING"), "unknown").otherwise(F.col("c_mktsegment"))
    return t.base("customer").select("c_custkey", genre.alias("genre"))


@query("SELECT event_id, sha256(CAST(user_id AS VARCHAR) || ':' || event_type) AS key FROM events")
def k08_idempotency_key(t: Tables):
    from placeworks.sources.files import idempotency_key

    return t.base("events").select("event_id", idempotency_key("user_id", "event_type").alias("key"))


@query("SELECT '<url><loc>https://x.example/s/' || CAST(c_custkey AS VARCHAR) || '</loc><lastmod>' || strftime(DATE '2023-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d') || '</lastmod></url>' AS value FROM customer JOIN nation ON c_nationkey = n_nationkey")
def k07_sitemap(t: Tables):
    from placeworks.sources import write_sitemap

    return write_sitemap(t.shop.select(F.concat(F.lit("/s/"), F.col("shop_id").cast("string")).alias("path"), F.col("created_on").alias("updated_on")), "https://x.example")


_QUEUE = {
    "pending": ("NOT approved AND NOT rejected AND NOT on_hold", 0), "rejected": ("rejected", 0), "all": ("true", 0), "unverified": ("unverified", 0), "hold": ("on_hold", 0), "one_suspect": ("candidate <> ''", 0),
    "one_missing": ("approved AND one_link = '' AND NOT starts_with(one, 'https://not-found.local/')", 1), "one_configured": ("approved AND one_link <> ''", 1), "one_not_found": ("approved AND starts_with(one, 'https://not-found.local/')", 1),
    "two_missing": ("approved AND two_link = '' AND NOT starts_with(two, 'https://not-found.local/')", 1), "two_configured": ("approved AND two_link <> ''", 1), "two_not_found": ("approved AND starts_with(two, 'https://not-found.local/')", 1),
    "three_missing": ("approved AND three = ''", 1), "three_configured": ("approved AND three <> '' AND NOT starts_with(three, 'https://not-found.local/')", 1), "three_not_found": ("approved AND starts_with(three, 'https://not-found.local/')", 1),
}


@query("""WITH s AS (SELECT shop_id, approved, on_hold, created_on, shop_id % 8 = 1 AS rejected, smoking_type = 3 AS unverified, CASE WHEN shop_id % 5 = 0 THEN 'c' ELSE '' END AS candidate, CASE WHEN shop_id % 3 = 0 THEN 'l' ELSE '' END AS one_link, CASE WHEN shop_id % 7 = 0 THEN 'https://not-found.local/1' ELSE '' END AS one,
CASE WHEN shop_id % 4 = 0 THEN 'l' ELSE '' END AS two_link, CASE WHEN shop_id % 9 = 0 THEN 'https://not-found.local/2' ELSE 'https://x.example' END AS two, CASE shop_id % 3 WHEN 0 THEN 'https://not-found.local/3' WHEN 1 THEN 'https://y.example' ELSE '' END AS three, coalesce(v.n, 0) AS views
FROM b_shop LEFT JOIN (SELECT shop_id, count(*) AS n FROM b_view WHERE NOT is_bot GROUP BY 1) v USING (shop_id)), m AS (""" + " UNION ALL ".join(f"SELECT '{name}' AS status, shop_id, created_on, views, {by} * views AS k FROM s WHERE {when}" for name, (when, by) in _QUEUE.items()) + """)
SELECT status, rank, shop_id, views FROM (SELECT *, CAST(row_number() OVER (PARTITION BY status ORDER BY k DESC, created_on DESC, shop_id DESC) AS INTEGER) AS rank FROM m) WHERE rank <= 20""")
def q15_all_queues(t: Tables):
    """The first twenty of each of the fifteen statuses, nine of which are ranked by views."""
    k = F.col("shop_id")
    some = lambda n, text, other=None: F.when(k % n == 0, text).otherwise(F.lit(other).cast("string"))
    shops = t.shop.select("shop_id", "approved", "on_hold", "created_on", (k % 8 == 1).alias("rejected"), (F.col("smoking_type") == 3).alias("unverified"), some(5, "c").alias("one_candidate_url"), some(3, "l", "").alias("one_affiliate_url"), some(7, "https://not-found.local/1").alias("one_url"), some(4, "l").alias("two_affiliate_url"),
        some(9, "https://not-found.local/2", "https://x.example").alias("two_url"), F.when(k % 3 == 0, "https://not-found.local/3").when(k % 3 == 1, "https://y.example").alias("three_url"))
    views = t.view.filter(~F.col("is_bot")).groupBy("shop_id").agg(F.count("*").alias("views"))
    return review.queues(shops, views, review.queue_conditions(["one", "two"], ["three"], "one"), 20)


@query("""WITH q AS (SELECT p_name AS query, CAST(sum(l_quantity) AS BIGINT) AS impressions, count(*) FILTER (WHERE l_returnflag = 'R') AS clicks, CAST(avg(1 + p_size) AS INTEGER) AS pos FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1),
x AS (SELECT *, CASE WHEN contains(query, 'widget') THEN 'BUILDING' WHEN contains(query, 'gadget') THEN 'FURNITURE' WHEN contains(query, 'cold') THEN 'MACHINERY' END AS genre FROM q),
n AS (SELECT genre, count(*) AS shops, count(*) FILTER (WHERE last_confirmed_on IS NOT NULL) AS confirmed FROM b_shop WHERE approved AND NOT on_hold GROUP BY 1)
SELECT query, genre, coalesce(shops, 0) AS shops, coalesce(confirmed, 0) AS confirmed, greatest(coalesce(shops, 0) + 2 * coalesce(confirmed, 0) + 20, 5) AS supply, CAST(floor((impressions + clicks * 5) * 10.0e0 / greatest(coalesce(shops, 0) + 2 * coalesce(confirmed, 0) + 20, 5) + 0.5e0) AS BIGINT) AS gap_x10 FROM x LEFT JOIN n USING (genre)""")
def q21_supply_by_query(t: Tables):
    """Each query with the genre its words name, and the supply of that genre: counts are made by genre once, then joined."""
    from placeworks.functions.text import first_rule

    log = t.base("part").join(t.base("lineitem"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_name").alias("query")).agg(F.sum("l_quantity").cast("long").alias("impressions"), F.count_if(F.col("l_returnflag") == "R").alias("clicks"))
    log = log.withColumn("genre", first_rule(F.col("query"), [("BUILDING", "widget"), ("FURNITURE", "gadget"), ("MACHINERY", "cold")]))
    supply = P.approved(t.shop).groupBy("genre").agg(F.count("*").alias("shops"), F.count("last_confirmed_on").alias("confirmed"))
    rows = log.join(supply, "genre", "left").fillna(0, ["shops", "confirmed"])
    rows = rows.withColumn("supply", S.supply(F.col("shops"), F.col("confirmed"), F.lit(1)))
    return rows.select("query", "genre", "shops", "confirmed", "supply", F.floor((F.col("impressions") + F.col("clicks") * 5) * 10.0 / F.col("supply") + 0.5).cast("long").alias("gap_x10"))
