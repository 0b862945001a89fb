"""Queries for operators that others only use within: classes of catalogue fields, normal forms, linkage steps, files, trailing counts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeworks.functions import classify as C
from placeworks.functions import hours as H
from placeworks.functions import scores as S
from placeworks.functions import text as T
from placeworks.functions import times as D
from placeworks.operators import linkage as L
from placeworks.operators import merging as M
from placeworks.operators import predicates as P
from placeworks.operators import review
from placeworks.operators.joins import first_rule_join
from placeworks.operators.ranking import rarest_blocks
from placeworks.operators.weekly import per_schedule
from placeworks.plans.registry import query
from placeworks.plans.roles import Tables
from placeworks.streaming import earliest_visits, trailing_counts


def _k():
    return F.col("c_custkey")


def _pick(k, *values):
    """The value that a key's remainder names."""
    return F.element_at(F.array(*[v if not isinstance(v, (str, int)) and v is not None else F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _list(*values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("SELECT shop_id FROM b_shop WHERE contains(genre, 'FURN') OR contains(area, 'FURN') OR contains(genre, 'AUTO') OR contains(area, 'AUTO')")
def f14_group_terms(t: Tables):
    return t.shop.filter(P.contains_term([F.col("genre"), F.col("area")], ["FURN", "AUTO"])).select("shop_id")


@query("SELECT shop_id FROM b_shop WHERE lat BETWEEN 34.6e0 AND 34.8e0 AND lon BETWEEN 135.4e0 AND 135.6e0")
def f28_checked_viewport(t: Tables):
    """A viewport whose bounds pass the checks; the tests try those that do not."""
    return P.in_viewport(t.shop, 34.6, 34.8, 135.4, 135.6).select("shop_id")


_NAMES = ["Ｃａｆｅ　Ａ・梅田店", "BAR (Second)", "ｶﾌｪ ー'B'"]


@query(f"SELECT c_custkey, {_list('cafea・梅田店', 'bar(second)', 'カフェー' + chr(39) + 'b' + chr(39))}[1 + c_custkey % 3] AS linkage, {_list('cafea梅田店', 'barsecond', 'カフェb')}[1 + c_custkey % 3] AS lookup FROM customer")
def t06_normal_names(t: Tables):
    """Names for linkage, and for lookup without signs."""
    name = _pick(_k(), *_NAMES)
    return t.base("customer").select(_k(), T.linkage_name(name).alias("linkage"), T.lookup_name(name).alias("lookup"))


@query("SELECT c_custkey, '大阪市北区' || CAST(c_custkey AS VARCHAR) AS address FROM customer")
def t11_without_postal_prefix(t: Tables):
    address = F.concat(_pick(_k(), "〒530-0001 ", "日本、〒5300001", "", "530-0001 "), F.lit("大阪市北区"), _k().cast("string"))
    return t.base("customer").select(_k(), T.without_postal_prefix(address).alias("address"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 70 < 60 THEN CAST(c_custkey % 31 * 60 + c_custkey % 70 AS INTEGER) END AS minute FROM customer")
def d04_long_minutes(t: Tables):
    clock = F.concat_ws(":", (_k() % 31).cast("string"), F.lpad((_k() % 70).cast("string"), 2, "0"))
    return t.base("customer").select(_k(), D.long_minutes(clock).alias("minute"))


@query("SELECT c_custkey AS id, concat_ws(' / ', CASE WHEN c_custkey % 3 = 0 THEN 'name is blank' END, CASE WHEN c_custkey % 5 = 0 THEN 'address is blank' END, CASE WHEN c_custkey % 7 = 0 THEN 'URL not valid' END) AS errors FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0")
def e02_row_validity(t: Tables):
    rows = t.base("customer").select(_k().alias("id"), F.when(_k() % 3 == 0, "　").otherwise("n").alias("name"), F.when(_k() % 5 == 0, None).otherwise("a").alias("address"), F.when(_k() % 7 == 0, "ftp://x/1").otherwise("https://x.example/1").alias("url"))
    return P.invalid_rows(rows, {"name is blank": T.is_blank(F.col("name")), "address is blank": T.is_blank(F.col("address")), "URL not valid": T.canonical_url(F.col("url")).isNull()}).select("id", "errors")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN sha256('[\"' || CASE c_custkey % 4 WHEN 1 THEN 'カフェa' ELSE 'bar' END || '\",\"梅田' || CAST(c_custkey % 9 + 1 AS VARCHAR) || '-2|ビル\"]') END AS identity FROM customer")
def e01_identity(t: Tables):
    """Name and address keys of a record and their digest, null where either is blank."""
    name = _pick(_k(), "Bar", "ｶﾌｪ A", "BAR", " ")
    p = t.base("customer").select(_k(), name.alias("name"), T.address_parts(F.concat(F.lit("〒530-0001 梅田"), (_k() % 9 + 1).cast("string"), F.lit("丁目2番 ビル"))).alias("p"))
    key = F.concat_ws("|", "p.street", F.coalesce("p.building", F.lit("")))
    digest = F.sha2(F.to_json(F.array(T.linkage_name(F.col("name")), key)), 256)
    return p.select("c_custkey", F.when(~T.is_blank(F.col("name")) & F.col("p.street").isNotNull(), digest).alias("identity"))


_LINK = """p AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS side, 'n' || CAST(c_custkey // 2 % 40 AS VARCHAR) AS name, 'a' || CAST(c_custkey // 2 % 20 AS VARCHAR) AS address, CASE WHEN c_custkey % 9 = 0 THEN 'u' || CAST(c_custkey % 4 AS VARCHAR) END AS url, c_custkey % 8 <> 5 AS complete FROM customer),
t AS (SELECT * FROM p WHERE side), f AS (SELECT * FROM p WHERE NOT side),
m AS (SELECT t.id AS target, f.id AS row, t.url AS t_url, f.url AS r_url, t.complete AND f.complete AS whole, count(*) OVER (PARTITION BY t.id) AS pool, (SELECT count(*) FROM f g WHERE g.name = f.name AND g.address = f.address) AS dup_rows, (SELECT count(*) FROM t g WHERE g.name = t.name AND g.address = t.address) AS dup_targets,
CASE WHEN f.url IS NULL THEN 1 ELSE (SELECT count(*) FROM f g WHERE g.url = f.url) END AS url_rows, CASE WHEN f.url IS NULL THEN 0 ELSE (SELECT count(*) FROM t g WHERE g.url = f.url) END AS owners FROM t JOIN f ON t.name = f.name AND t.address = f.address),
c AS (SELECT target, row, CASE WHEN t_url = r_url THEN 'registered' WHEN t_url IS NOT NULL OR owners > 0 THEN 'conflict' WHEN pool = 1 AND dup_rows = 1 AND dup_targets = 1 AND url_rows = 1 AND whole THEN 'bulk' ELSE 'review' END AS class, CASE WHEN pool > 1 OR dup_rows > 1 OR dup_targets > 1 THEN 200 ELSE 400 END AS confidence,
row_number() OVER (PARTITION BY target ORDER BY row) AS rank, concat_ws(' / ', 'same name', 'same address', CASE WHEN dup_rows > 1 THEN 'repeated in file' END, CASE WHEN url_rows > 1 THEN 'URL repeated' END, CASE WHEN dup_targets > 1 THEN 'repeated in catalogue' END, CASE WHEN NOT whole THEN 'address incomplete' END) AS reason FROM m)"""


def _exact_run(t: Tables):
    """Two catalogues that share names and addresses, so that all pairs are exact: what the ranks over grams decide has no part."""
    half = F.floor(_k() / 2)
    rows = t.base("customer").select(_k().alias("id"), F.concat(F.lit("n"), (half % 40).cast("string")).alias("name"), F.lit("c").alias("city"), F.concat(F.lit("s"), _k().cast("string")).alias("street"), F.concat(F.lit("a"), (half % 20).cast("string")).alias("address"), (_k() % 8 != 5).alias("complete"), F.when(_k() % 9 == 0, F.concat(F.lit("u"), (_k() % 4).cast("string"))).alias("url"))
    targets, file = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    matches = L.exact_matches(targets, file)
    return matches, L.verdicts(targets, matches)


@query(f"WITH {_LINK} SELECT target, row, class, CAST(confidence AS INTEGER) AS confidence, CAST(rank AS INTEGER) AS rank, reason FROM c WHERE rank <= 25")
def e08_pair_classes(t: Tables):
    """Rank and cap, class, confidence and reason of exact pairs."""
    return _exact_run(t)[0].select("target", "row", "class", F.col("confidence").cast("int").alias("confidence"), "rank", "reason")


@query(f"WITH {_LINK}, n AS (SELECT target, count(*) AS n, count(*) FILTER (WHERE class = 'registered') AS same, any_value(class) AS one FROM c WHERE rank <= 25 GROUP BY 1) SELECT id AS target, CASE WHEN n IS NULL THEN CASE WHEN url IS NOT NULL THEN 'registered' ELSE 'unmatched' END WHEN n = same THEN 'registered' WHEN n = 1 THEN one ELSE 'review' END AS class FROM t LEFT JOIN n ON id = target")
def e10_target_classes(t: Tables):
    return _exact_run(t)[1]


@query(f"WITH {_LINK}, d AS (SELECT *, count(*) OVER (PARTITION BY row) AS n FROM c WHERE rank <= 25) SELECT target, row, CASE WHEN n > 1 AND class = 'bulk' THEN 'review' ELSE class END AS class FROM d")
def e11_row_first(t: Tables):
    return L.row_first(_exact_run(t)[0]).select("target", "row", "class")


@query("""WITH o AS (SELECT p_partkey % 50 AS target, p_partkey AS row FROM part WHERE p_partkey % 3 = 0), n AS (SELECT p_partkey % 50 AS target, p_partkey AS row, 100 + p_size * 10 AS score FROM part WHERE p_partkey % 2 = 0),
e AS (SELECT target, row, coalesce(score, 0) AS score FROM o LEFT JOIN n USING (target, row) UNION ALL SELECT target, row, score FROM n WHERE (target, row) NOT IN (SELECT (target, row) FROM o) AND target % 5 <> 0)
SELECT target, row, CAST(CASE WHEN count(*) OVER (PARTITION BY target) > 1 THEN least(score, 200) ELSE score END AS INTEGER) AS score FROM e""")
def e13_refreshed(t: Tables):
    k = F.col("p_partkey")
    part = t.base("part")
    old = part.filter(k % 3 == 0).select((k % 50).alias("target"), k.alias("row"), F.lit(1).alias("score"))
    new = part.filter(k % 2 == 0).select((k % 50).alias("target"), k.alias("row"), (100 + F.col("p_size") * 10).cast("int").alias("score"))
    return L.refreshed(old, new, t.spark.range(0, 50, 5).select(F.col("id").alias("target"))).select("target", "row", F.col("score").cast("int").alias("score"))


@query("SELECT shop_id FROM b_shop WHERE approved AND NOT on_hold AND shop_id NOT IN (SELECT shop_id FROM b_report WHERE status = 'F')")
def e14_missing_targets(t: Tables):
    return L.missing_targets(t.shop, t.report.filter("status = 'F'").select("shop_id").distinct()).select("shop_id")


@query("SELECT c_custkey, c_custkey % 2 = 1 AND c_custkey % 3 = 0 AND c_custkey % 5 <> 1 AND c_custkey % 5 <> 2 AND c_custkey % 7 <> 1 AS matches FROM customer")
def e15_strict_match(t: Tables):
    address = _pick(_k(), "x 1-2", "x 1-3", "x", "x 1-2", "x 1-2")
    other = _pick(_k(), "x 1-2", "x 1-2", "x", "x 1-2", "x 1-2")
    match = L.strict_match(_k() % 2 == 0, _pick(_k(), "n", "m", "o"), F.lit("n"), address, other, F.when(_k() % 7 < 2, "06"), F.when(_k() % 7 == 1, "07").otherwise("06"))
    return t.base("customer").select(_k(), match.alias("matches"))


@query("""WITH h AS (SELECT user_id AS shop, CAST(event_id % 3 AS INTEGER) AS stage, event_id % 2 AS found FROM events WHERE event_id % 4 > 0), n AS (SELECT shop, stage, count(DISTINCT found) AS n, min(found) AS found FROM h GROUP BY ALL)
SELECT shop, CASE WHEN n = 1 THEN found END AS found, CASE WHEN n = 1 THEN 'match' ELSE 'review' END AS verdict FROM (SELECT shop, arg_min(n, stage) AS n, arg_min(found, stage) AS found FROM n GROUP BY 1)""")
def e16_staged_search(t: Tables):
    e = F.col("event_id")
    return L.staged(t.base("events").filter(e % 4 > 0).select(F.col("user_id").alias("shop"), (e % 3).cast("int").alias("stage"), (e % 2).alias("found")))


@query("""WITH s AS (SELECT c_custkey AS shop_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 60 END AS place, c_custkey % 40 AS phone, c_custkey % 30 AS name FROM customer), n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 90 END AS place, CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 55 END AS phone, p_partkey % 33 AS name FROM part)
SELECT id, coalesce((SELECT min(shop_id) FROM s WHERE s.place = n.place), (SELECT min(shop_id) FROM s WHERE s.phone = n.phone), (SELECT min(shop_id) FROM s WHERE s.name = n.name)) AS shop_id FROM n""")
def e19_upsert_target(t: Tables):
    k = F.col("p_partkey")
    shops = t.base("customer").select(_k().alias("shop_id"), F.when(_k() % 2 == 0, _k() % 60).alias("place_id"), (_k() % 40).alias("phone"), (_k() % 30).alias("name"), F.lit("a").alias("address"))
    new = t.base("part").select(k.alias("id"), F.when(k % 3 == 0, k % 90).alias("place_id"), F.when(k % 3 < 2, k % 55).alias("phone"), (k % 33).alias("name"), F.lit("a").alias("address"))
    return L.upsert_target(new, shops).select("id", "shop_id")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'umeda' WHEN 1 THEN 'namba' WHEN 2 THEN 'kita' END AS area, CASE c_custkey % 4 WHEN 3 THEN 'none' ELSE 'bar' END AS genre FROM customer")
def c01_detected_area(t: Tables):
    """Area by its rules, then by the second pass of fallbacks; genre by keyword."""
    text = _pick(_k(), "Bar near Umeda station", "namba bar", "bar in kitaku", "ramen")
    first, second = [("umeda", "umeda|osaka st"), ("namba", "namba|nanba")], [("kita", "kitaku")]
    return t.base("customer").select(_k(), F.coalesce(T.first_rule(text, first), T.first_rule(text, second)).alias("area"), T.first_rule(text, [("bar", "bar")], "none").alias("genre"))


_QUERIES = ["what is smoking", "what is shisha", "a & b", "ｂar", "one two three four", "one two three bar", "plain words"]


@query("SELECT c_custkey, [false, true, true, true, true, false, false][1 + c_custkey % 7] AS odd FROM customer")
def c04_unnatural(t: Tables):
    return t.base("customer").select(_k(), S.unnatural(_pick(_k(), *_QUERIES), "smoking", "what is", "bar").alias("odd"))


_SHOPS = ["1-2-3 kita", "brandx", "smoking cafe", "hanako shop", "kita honten", "a b", "a b c d"]


@query("SELECT c_custkey, [true, true, false, true, true, true, false][1 + c_custkey % 7] AS shop FROM customer")
def c05_looks_like_shop(t: Tables):
    return t.base("customer").select(_k(), C.looks_like_shop(_pick(_k(), *_SHOPS), r"\d+-\d+", ["brandx"], ["smoking"], ["shop"], "honten$").alias("shop"))


@query("SELECT c_custkey, ['brand_check', 'facility', 'specific_shop', 'specific_shop', 'general'][1 + c_custkey % 5] AS kind FROM customer")
def c06_query_type(t: Tables):
    text = _pick(_k(), "placeworks map", "station smoking room", "odd & query", "hanako", "bars in kita")
    return t.base("customer").select(_k(), C.query_type(text, ["placeworks"], ["station"], text.contains("&"), text == "hanako", F.lit(False), F.lit(False)).alias("kind"))


@query("SELECT c_custkey, ['umeda', 'namba', NULL][1 + c_custkey % 3] AS area FROM customer")
def c27_area(t: Tables):
    rules = [("umeda", "梅田"), ("namba", "難波")]
    return t.base("customer").select(_k(), C.area(_pick(_k(), "東 梅田 駅", "x", "y"), _pick(_k(), "難波1", "難波2", "z"), rules).alias("area"))


@query("SELECT c_custkey, ['cafe', 'pub', 'other', 'pub'][1 + c_custkey % 4] AS genre, [NULL, NULL, 'sushi', NULL][1 + c_custkey % 4] AS original FROM customer")
def c28_genre(t: Tables):
    g = C.genre(_pick(_k(), "カフェ・喫茶", "呑み屋", "sushi", "pub"), {"カフェ": "cafe"}, {"呑み屋": "pub"}, ["cafe", "pub"], "other")
    return t.base("customer").select(_k(), g.alias("g")).select("c_custkey", "g.genre", "g.original")


@query("SELECT c_custkey, CAST(c_custkey % 3 * 10 + c_custkey % 2 * 6 + CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END AS INTEGER) AS score FROM customer")
def c29_relatedness(t: Tables):
    return t.base("customer").select(_k(), S.relatedness((_k() % 3).cast("int"), (_k() % 2).cast("int"), _k() % 5 == 0).cast("int").alias("score"))


@query("SELECT c_custkey, c_custkey % 3 > 0 AND c_custkey % 5 > 0 AS may FROM customer")
def c31_may_be_approved(t: Tables):
    may = C.may_be_approved([F.when(_k() % 3 == 0, " ").otherwise("n"), F.lit("a")], F.when(_k() % 5 == 0, "hours Unknown").otherwise("fine"), ["unknown"])
    return t.base("customer").select(_k(), may.alias("may"))


@query("SELECT c_custkey, CAST([1, 1, 2, NULL][1 + c_custkey % 4] AS INTEGER) AS code FROM customer")
def c32_code(t: Tables):
    return t.base("customer").select(_k(), C.code(_pick(_k(), " ALL ", "1", "part", "?"), {"all": 1, "1": 1, "part": 2, "2": 2}).alias("code"))


@query("SELECT c_custkey, ['read', 'write', 'other'][1 + c_custkey % 3] AS class FROM customer")
def c33_statement_class(t: Tables):
    return t.base("customer").select(_k(), C.statement_class(_pick(_k(), "SELECT 1", "update x set y", "BEGIN"), [("read", "^select"), ("write", "^(insert|update|delete)")]).alias("class"))


@query("SELECT c_custkey, ['article', 'shop', 'list', 'other'][1 + c_custkey % 4] AS kind FROM customer")
def c34_page_type(t: Tables):
    return t.base("customer").select(_k(), S.page_type(_pick(_k(), "/articles/1", "/shops/2", "/umeda/bar", "/1")).alias("kind"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AND c_custkey % 3 = 0 AS restricted FROM customer")
def c36_restricted(t: Tables):
    return t.base("customer").select(_k(), C.restricted(F.when(_k() % 2 == 0, "ランチ禁煙").otherwise("ok"), F.when(_k() % 3 == 0, " ").otherwise("10:00-11:00"), "ランチ.*禁煙").alias("restricted"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN m >= 1080 OR m < 120 WHEN 1 THEN m >= 600 AND m < 900 ELSE m >= 1080 END AS inside FROM (SELECT c_custkey, c_custkey * 7 % 1440 AS m FROM customer)""")
def i08_with_spill(t: Tables):
    """Custom hours: yesterday's night goes on today, tonight's does not count before it begins."""
    one = lambda a, b: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")))
    none = F.array().cast(H.RANGES)
    night, day = one(1080, 120).cast(H.RANGES), one(600, 900).cast(H.RANGES)
    k = _k() % 3
    return t.base("customer").select(_k(), H.with_spill(F.when(k == 1, day).otherwise(night), F.when(k == 0, night).otherwise(none), (_k() * 7 % 1440).cast("int")).alias("inside"))


@query("SELECT o_orderkey, (o_orderkey * 37) % 24 * 100 + (o_orderkey * 53) % 24 AS value FROM orders")
def i11_once_per_schedule(t: Tables):
    k = F.col("o_orderkey")
    rows = t.base("orders").select(k, (k * 37 % 24).alias("a"), (k * 53 % 24).alias("b"))
    return per_schedule(rows, ["a", "b"], F.col("a") * 100 + F.col("b"), "value").select("o_orderkey", "value")


@query("SELECT o_orderkey, p_type AS value FROM (SELECT o_orderkey, o_orderpriority AS p_type FROM orders)")
def p13_dictionary(t: Tables):
    """Values by their hash, and rows that carry the hash, joined again."""
    values, rows = M.dictionary(t.base("orders").select("o_orderkey", F.col("o_orderpriority").alias("value")), "value")
    return rows.join(values, "value_id").select("o_orderkey", "value")


@query("SELECT shop_id, CAST(row_number() OVER (ORDER BY c > 0 DESC, conf DESC NULLS LAST, views DESC, shop_id) AS INTEGER) AS place FROM (SELECT shop_id, shop_id % 3 AS c, CASE WHEN shop_id % 3 > 0 THEN shop_id % 5 END AS conf, shop_id % 7 AS views FROM b_shop) ORDER BY place LIMIT 60")
def o06_tab_order(t: Tables):
    """First sixty of the open tab: those with matches, by confidence, views and id."""
    s = F.col("shop_id")
    rows = t.shop.select("shop_id", s.alias("target"), (s % 3).alias("matches"), F.when(s % 3 > 0, s % 5).alias("confidence"), (s % 7).alias("views"))
    order = review.tab_order("unregistered")
    return rows.orderBy(*order).limit(60).select("shop_id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("SELECT shop_id FROM b_shop ORDER BY shop_id LIMIT 30")
def o09_page_overflow(t: Tables):
    """A page beyond the last, of a size that is not offered, is the first of the smallest size."""
    from placeworks.operators.ranking import page

    return page(t.shop.select("shop_id"), [F.asc("shop_id")], 9999, 77, total=100, sizes=(30, 50, 100))


@query("""WITH g AS (SELECT p_partkey AS id, p_brand AS city, unnest(list_distinct([substr(p_name, CAST(i AS INTEGER), 2) FOR i IN range(1, length(p_name))])) AS gram FROM part), n AS (SELECT city, gram, count(*) AS n FROM g GROUP BY ALL)
SELECT id, gram FROM (SELECT id, gram, row_number() OVER (PARTITION BY id ORDER BY n, gram) AS k FROM g JOIN n USING (city, gram)) WHERE k <= 2""")
def w07_rarest_blocks(t: Tables):
    """The two rarest grams of each name within its city."""
    grams = t.base("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("city"), F.explode(T.bigrams(F.col("p_name"))).alias("gram"))
    return rarest_blocks(grams, "id", ["city", "gram"], 2).select("id", "gram")


@query("""SELECT CAST(d + n AS DATE) AS day, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CAST(created_at AS DATE) AS d, count(*) AS c FROM b_view GROUP BY 1), (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS n) GROUP BY 1""")
def r04_trailing_views(t: Tables):
    """Views of the seven days before each day, by the same expression as on a stream; ``tests/test_streaming.py`` runs that with late events."""
    return trailing_counts(t.view.withColumn("created_at", F.col("created_at").cast("timestamp")), 7)


@query("SELECT shop_id, visitor, CAST(created_at AS DATE) AS day, min(created_at) AS first_at FROM b_view WHERE NOT is_bot GROUP BY ALL")
def r01_earliest_views(t: Tables):
    """The earliest view of each visitor, shop and day, by the event-time expression of the stream."""
    views = t.view.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return earliest_visits(views, keys=["shop_id", "visitor"]).select("shop_id", "visitor", "day", F.col("created_at").cast("timestamp_ntz").alias("first_at"))


@query("SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM b_view GROUP BY 1 ORDER BY 1")
def r04_views_by_day(t: Tables):
    """What the trailing windows add up: views by day; the tests run the windows themselves as a stream."""
    return t.view.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def r06_delivered_once(t: Tables):
    """One event of each delivery key."""
    return t.base("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT name, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT p_name AS name, CASE WHEN contains(p_name, 'widget') THEN 'tool' WHEN contains(p_name, 'cold') THEN 'weather' END AS label FROM part) GROUP BY 1")
def j12_rule_table(t: Tables):
    """The first rule of a table of rules for each name."""
    rules = t.spark.createDataFrame([(1, "tool", "widget"), (2, "weather", "cold")], "rule_order int, label string, keyword string")
    return first_rule_join(t.base("part").select(F.col("p_name").alias("name")).distinct(), "name", rules, "name").select("name", F.col("label").alias("labels"))


def _written_csv(t: Tables, rows, preamble: list[str], header: str):
    """A folder with one text file: lines above a header, and rows below it."""
    import uuid

    from placeworks.sources.files import shared_folder

    path = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"
    first = t.spark.createDataFrame([(x,) for x in [*preamble, header]], "value string").coalesce(1)
    first.unionByName(rows).coalesce(1).write.text(path)
    return path


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def s04_csv_after_preamble(t: Tables):
    """A report read back: its header is the first line that begins with a known column."""
    from placeworks.sources import csv_after_preamble

    lines = t.base("nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    return csv_after_preamble(t.spark, _written_csv(t, lines, ["report of today", "all nations,with commas"], "id,name"), "id,")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'r' || CAST(n_regionkey AS VARCHAR) END AS name FROM nation")
def s05_guessed_header(t: Tables):
    """A header guessed by its words, and columns found by their synonyms, the first that is not blank."""
    from placeworks.sources import csv_with_header_guess, resolve_columns

    k = F.col("n_nationkey")
    lines = t.base("nation").select(F.concat_ws(",", k.cast("string"), F.when(k % 2 == 0, F.col("n_name")).otherwise(" "), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("value"))
    path = _written_csv(t, lines, ["exported"], "Key,Store Name,Title")
    return resolve_columns(csv_with_header_guess(t.spark, path, ["store name"]), {"id": ["key", "id"], "name": ["store name", "title"]})


@query("""SELECT c_custkey // 500 AS file, c_custkey AS id, CAST(row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) + 1 AS INTEGER) AS line_number, c_custkey % 50 <> 7 AS valid,
CASE WHEN c_custkey % 50 <> 7 THEN c_name || ', ' || c_mktsegment END AS name FROM customer""")
def s08_strict_files(t: Tables):
    """Files of five hundred customers in the strict form (S07-S10), one line in fifty with a quote inside a field: the record there is invalid, line numbers stay."""
    from placeworks.sources.files import strict_csv_files

    k = F.col("c_custkey")
    line = F.concat(k.cast("string"), F.lit(',"'), "c_name", F.when(k % 50 == 7, F.lit('"x" ')).otherwise(F.lit(", ")), "c_mktsegment", F.lit('"'))
    rows = t.base("customer").groupBy(F.floor(k / 500).alias("file")).agg(F.array_sort(F.collect_list(F.struct(k, line.alias("line")))).alias("rows"))
    content = F.concat(F.lit("id,name\r\n"), F.array_join(F.transform("rows", lambda x: x["line"]), "\r\n"))
    files = rows.select(F.col("file").cast("string").alias("path"), content.cast("binary").alias("content"))
    found = strict_csv_files(files, ["id", "name"])
    ids = rows.select(F.col("file").cast("string").alias("path"), F.posexplode(F.transform("rows", lambda x: x["c_custkey"])).alias("pos", "key")).withColumn("line_number", F.col("pos") + 2)
    return found.drop("id").join(ids, ["path", "line_number"]).select(F.col("path").cast("long").alias("file"), F.col("key").alias("id"), "line_number", "valid", "name")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS batch, n_nationkey, n_name FROM nation WHERE n_regionkey <> 3")
def k02_bulk_insert(t: Tables):
    """A batch for each region, one of them written twice and one staged without a commit: each committed row is there once."""
    import uuid

    from placeworks.sources.files import append_once, appended, shared_folder

    path = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"
    rows = t.base("nation").select("n_nationkey", "n_name", "n_regionkey")
    for region in (0, 1, 2, 4, 1):
        append_once(rows.filter(F.col("n_regionkey") == region).drop("n_regionkey"), path, str(region))
    rows.filter("n_regionkey = 3").drop("n_regionkey").write.parquet(f"{path}/rows/batch=3")
    return appended(t.spark, path).select("batch", "n_nationkey", "n_name")


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def k05_rebuilt_partitions(t: Tables):
    """Two writes of a partitioned table, the second of some partitions only: the others stay, no row is doubled."""
    import uuid

    from placeworks.sources.files import shared_folder

    path = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"
    rows = t.base("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    M.rebuild(t.spark, rows, path, "region")
    M.rebuild(t.spark, rows.filter("region < 2"), path, "region")
    return t.spark.read.parquet(path).groupBy(F.col("region").cast(dict(rows.dtypes)["region"]).alias("region")).agg(F.count("*").alias("n"))


@query("""SELECT '{"total":' || CAST((SELECT count(*) FROM nation) AS VARCHAR) || ',"rows":[' || string_agg('{"n_nationkey":' || CAST(n_nationkey AS VARCHAR) || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']}' AS json FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 5)""")
def k06_json_page(t: Tables):
    """A page of five rows with the total, as one document."""
    from placeworks.sources import write_json_page

    rows = t.base("nation").select("n_nationkey", "n_name")
    return write_json_page(rows, rows.count(), rows.orderBy("n_nationkey").limit(5).coalesce(1).sortWithinPartitions("n_nationkey"))
