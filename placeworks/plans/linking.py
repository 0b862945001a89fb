"""Linkage and duplicates over text records."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeworks.functions.text import bigrams, dice, similarity
from placeworks.operators import linkage as L
from placeworks.operators import ranking as R
from placeworks.operators import blocks, review, similar
from placeworks.plans.registry import query
from placeworks.plans.roles import Tables
from placeworks.sources.files import written

_GRAMS = "list_distinct([substr(left({c}, 80), CAST(i AS INTEGER), 2) FOR i IN range(1, greatest(length(left({c}, 80)), 2))])"
_DICE = "CASE WHEN a.name = b.name AND a.name <> '' THEN 1.0e0 WHEN len(a.g) + len(b.g) > 0 THEN 2.0e0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) ELSE 0.0e0 END"


@query(f"SELECT id, CASE WHEN length(name) >= 2 THEN len({_GRAMS.format(c='name')}) ELSE 0 END AS n FROM (SELECT id, CASE WHEN id % 9 = 0 THEN left(name, 1) ELSE name END AS name FROM b_record)")
def t14_bigrams(t: Tables):
    """Grams of names, some of one character, which have none."""
    name = F.when(F.col("id") % 9 == 0, F.substring("name", 1, 1)).otherwise(F.col("name"))
    return t.record.select("id", F.size(bigrams(name)).cast("long").alias("n"))


_NAMED = f"r AS (SELECT *, {_GRAMS.format(c='name')} AS g FROM b_record WHERE length(name) >= 2 AND NOT regexp_full_match(name, '[\\s　]*'))"


@query(f"WITH {_NAMED} SELECT a.id AS a, b.id AS b, CAST(floor({_DICE} * 1000 + 0.5e0) AS BIGINT) AS x1000 FROM r a JOIN r b ON a.city = b.city AND a.street = b.street AND a.id < b.id")
def t15_dice(t: Tables):
    """Similarity of all records of one city and street."""
    r = t.record.filter(F.length("name") >= 2).filter(~F.col("name").rlike("^[\\s　]*$"))
    return blocks.dice_of_groups(r.select("id", "city", "street", F.col("name").alias("text")), ["city", "street"])


@query(f"""WITH r AS (SELECT *, {_GRAMS.format(c='name')} AS g FROM b_record WHERE length(name) >= 2 AND NOT regexp_full_match(name, '[\\s　]*')) SELECT a.id AS a, b.id AS b, CAST(floor({_DICE} * 1000 + 0.5e0) AS BIGINT) AS x1000
FROM r a JOIN r b ON a.id = b.id - 1""")
def t15_neighbours(t: Tables):
    """Similarity of each record and the next by id."""
    r = t.record.filter(F.length("name") >= 2).filter(~F.col("name").rlike("^[\\s　]*$"))
    g = r.withColumn("g", bigrams(F.col("name")))
    a, b = g.alias("a"), g.withColumn("before", F.col("id") - 1).alias("b")
    like = F.when(F.col("a.name") == F.col("b.name"), 1.0).otherwise(dice(F.col("a.g"), F.col("b.g")))
    return a.join(b, F.col("a.id") == F.col("b.before")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.floor(like * 1000 + 0.5).cast("long").alias("x1000"))


_SETS = f"SELECT id, name, {_GRAMS.format(c='name')} AS g FROM (SELECT min(id) AS id, name FROM b_record WHERE length(name) >= 2 GROUP BY name)"


@query(f"""WITH s AS ({_SETS}) SELECT a.id AS a, b.id AS b, CAST(floor(2000.0e0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) + 0.5e0) AS BIGINT) AS x1000
FROM s a JOIN s b ON a.name < b.name AND 2.0e0 * least(len(a.g), len(b.g)) >= 0.8e0 * (len(a.g) + len(b.g)) - 1e-9 WHERE 2.0e0 * len(list_intersect(a.g, b.g)) >= 0.8e0 * (len(a.g) + len(b.g)) - 1e-9""")
def e22_similar_names(t: Tables):
    """All pairs of distinct names whose bigrams are alike by 0.8 or more, by the smallest id of each."""
    names = t.record.filter(F.length("name") >= 2).groupBy("name").agg(F.min("id").alias("id"))
    ordered = written(names.orderBy("name").select(F.monotonically_increasing_id().alias("pos"), "id", blocks.prefix(F.col("name")).alias("text")))
    return blocks.near_pairs(ordered, 0.8)


@query(f"""WITH s AS ({_SETS}), p AS (SELECT a.name AS x, b.name AS y FROM s a JOIN s b ON a.name <> b.name AND 2.0e0 * least(len(a.g), len(b.g)) >= 0.8e0 * (len(a.g) + len(b.g)) - 1e-9
WHERE 2.0e0 * len(list_intersect(a.g, b.g)) >= 0.8e0 * (len(a.g) + len(b.g)) - 1e-9), q AS (SELECT x, min(id) AS near FROM p JOIN s ON s.name = y GROUP BY x),
e AS (SELECT r.id, least((SELECT min(o.id) FROM b_record o WHERE o.name = r.name AND o.id <> r.id), near) AS other FROM b_record r LEFT JOIN q ON x = r.name) SELECT id, other FROM e WHERE other IS NOT NULL""")
def e22_first_similar(t: Tables):
    """For each record the smallest other one of an equal or similar name: the last step of the cascade, over all records."""
    return similar.first_similar(t.record.select("id", F.col("name").alias("text")), 0.8)


def _sides(t: Tables):
    """Even records are the catalogue, odd ones the file."""
    r = t.record.withColumn("name", F.regexp_replace("name", r"[\s　]+", "")).withColumn("address", F.concat(F.coalesce("city", F.lit("?")), F.lit("|1-2")))
    r = r.withColumn("complete", F.lit(True)).withColumn("url", F.when(F.col("id") % 7 == 0, F.concat(F.lit("u"), (F.col("id") % 90).cast("string"))))
    return r.filter("id % 2 = 0"), r.filter("id % 2 = 1")


_SIDES = """r AS (SELECT id, regexp_replace(name, '[\\s　]+', '', 'g') AS name, city, street, coalesce(city, '?') || '|1-2' AS address, CASE WHEN id % 7 = 0 THEN 'u' || CAST(id % 90 AS VARCHAR) END AS url FROM b_record),
t AS (SELECT * FROM r WHERE id % 2 = 0), f AS (SELECT * FROM r WHERE id % 2 = 1)"""
@query("""WITH s AS (SELECT c_custkey AS id, CAST(c_custkey * 7 % 60 AS INTEGER) AS like, c_custkey % 4 = 0 AS same_address, c_custkey % 3 = 0 AS same_street, c_custkey % 2 = 0 AS same_city, c_custkey % 5 = 0 AS same_name FROM customer)
SELECT id, CAST(CASE WHEN same_name AND same_address THEN 400 WHEN same_street AND same_name THEN 200 WHEN same_city AND same_name THEN 100 ELSE 0 END AS INTEGER) AS score FROM s""")
def e05_score_ladder(t: Tables):
    """The ladder over the sixteen combinations of what agrees; names that differ share no bigram."""
    k = F.col("c_custkey")
    pick = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    name = pick(5, "abcd", "wxyz")
    like = F.when(name == "abcd", 1.0).otherwise(0.0)
    score = L.confidence(F.lit("abcd"), name, F.lit("s 1-2"), pick(4, "s 1-2", "s 1-3"), F.lit("s1"), pick(3, "s1", "s2"), F.lit("c1"), pick(2, "c1", "c2"), F.lit(True), like, name == "abcd")
    return t.base("customer").select(k.alias("id"), score.cast("int").alias("score"))


@query(f"""WITH {_SIDES} SELECT t.id AS target, f.id AS row FROM t JOIN f ON t.name = f.name AND t.address = f.address WHERE t.name <> ''""")
def e04_exact_pairs(t: Tables):
    targets, rows = _sides(t)
    return L.candidate_pairs(targets, rows).filter("exact").select("target", "row")


@query()
def q24_linkage(t: Tables):
    """Pairs with class and confidence, catalogue first. Which rows of a block count depends on ranks over grams: compared
    with a brute-force version in the tests."""
    targets, rows = _sides(t)
    return L.linked(targets, rows)[0]


@query()
def q25_linkage_row_first(t: Tables):
    return L.row_first(q24_linkage(t))


@query()
def q26_linkage_tabs(t: Tables):
    """Targets by class."""
    targets, rows = _sides(t)
    return L.linked(targets, rows)[1].groupBy("class").agg(F.count("*").alias("n"))


@query(f"WITH {_SIDES}, one AS (SELECT name, min(id) AS row FROM f GROUP BY 1 HAVING count(*) = 1) SELECT t.id AS target, row FROM t JOIN one USING (name)")
def e18_unique_by_name(t: Tables):
    targets, rows = _sides(t)
    return L.unique_by_name(targets, rows)


def _people(t: Tables):
    """Records with keys that some of them share."""
    c = t.base("customer")
    k = F.col("c_custkey")
    return c.select(k.alias("id"), F.concat(F.lit("p"), (k % 1301).cast("string")).alias("place_id"), F.concat(F.lit("0"), (k % 997).cast("string")).alias("phone"), F.concat(F.lit("n"), (k % 811).cast("string")).alias("name"),
        F.concat(F.lit("a"), (k % 701).cast("string")).alias("address"), F.concat(F.lit("N"), (k % 811).cast("string")).alias("name_key"), F.concat(F.lit("A"), (k % 701).cast("string")).alias("address_key"), (F.col("c_acctbal") >= 0).alias("approved"), (k % 10 == 7).alias("rejected"))


_PEOPLE = "p AS (SELECT c_custkey AS id, c_custkey % 1301 AS place_id, c_custkey % 997 AS phone, c_custkey % 811 AS name, c_custkey % 701 AS address, c_acctbal >= 0 AS approved, c_custkey % 10 = 7 AS rejected FROM customer)"
_SCORE = """CASE WHEN a.place_id = b.place_id THEN 100 ELSE 0 END + CASE WHEN a.phone = b.phone THEN 60 ELSE 0 END + CASE WHEN a.name = b.name THEN 70 ELSE 0 END + CASE WHEN a.address = b.address THEN 70
WHEN contains('A' || CAST(a.address AS VARCHAR), 'A' || CAST(b.address AS VARCHAR)) OR contains('A' || CAST(b.address AS VARCHAR), 'A' || CAST(a.address AS VARCHAR)) THEN 15 ELSE 0 END + CASE WHEN b.approved THEN 5 WHEN b.rejected THEN 1 ELSE 0 END"""


@query(f"""WITH {_PEOPLE}, s AS (SELECT a.id, b.id AS other, {_SCORE} AS score, CASE WHEN a.place_id = b.place_id THEN 0 WHEN a.phone = b.phone THEN 1 WHEN a.name = b.name THEN 2 ELSE 3 END AS branch
FROM p a JOIN p b ON a.id <> b.id AND (a.place_id = b.place_id OR a.phone = b.phone OR a.name = b.name OR a.address = b.address))
SELECT id, other, CAST(branch AS INTEGER) AS branch, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, branch, other) AS rank FROM s) WHERE rank <= 10""")
def q27_duplicate_candidates(t: Tables):
    """Scores of records that share a key."""
    return L.duplicate_candidates(_people(t))


@query("SELECT a.id FROM (SELECT c_custkey AS id, c_custkey % 31 AS n, c_custkey % 3 AS a FROM customer WHERE c_acctbal < 0) a WHERE EXISTS (SELECT 1 FROM customer b WHERE b.c_acctbal >= 0 AND b.c_custkey % 31 = a.n AND b.c_custkey % 3 = a.a)")
def e25_approval_gate(t: Tables):
    k = F.col("c_custkey")
    rows = t.base("customer").select(k.alias("id"), (k % 31).alias("name"), (k % 3).alias("address"), (F.col("c_acctbal") >= 0).alias("approved"))
    return L.approval_blocked(rows.filter("not approved"), rows).select("id")


@query("""SELECT shop_id, CASE WHEN state IN ('applied', 'skipped') OR (state = 'pending' AND shop_id % 11 = 0) THEN 'registered' WHEN state = 'excluded' THEN 'excluded' WHEN state = 'held' THEN 'held' WHEN state = 'url_conflict' THEN 'url_conflict' ELSE 'unregistered' END AS tab
FROM (SELECT shop_id, CASE shop_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'applied' WHEN 2 THEN 'excluded' WHEN 3 THEN 'held' WHEN 4 THEN 'url_conflict' ELSE 'skipped' END AS state FROM b_shop)""")
def l07_tabs(t: Tables):
    k = F.col("shop_id") % 6
    state = F.when(k == 0, "pending").when(k == 1, "applied").when(k == 2, "excluded").when(k == 3, "held").when(k == 4, "url_conflict").otherwise("skipped")
    done = (F.col("shop_id") % 11 == 0) & (k == 0)
    return t.shop.withColumn("state", state).select("shop_id", review.tab(F.col("state"), F.lit("review"), done, F.lit(False)).alias("tab"))


@query("SELECT shop_id, tab, rank FROM (SELECT shop_id, area AS tab, CAST(row_number() OVER (PARTITION BY area ORDER BY smoking_area DESC, shop_id) AS INTEGER) AS rank FROM b_shop) WHERE rank <= 25")
def w04_rank_and_cap(t: Tables):
    return R.top_by(t.shop.select("shop_id", F.col("area").alias("tab"), "smoking_area"), "tab", 25, [F.desc("smoking_area"), F.asc("shop_id")]).select("shop_id", "tab", "rank")


_TAB_SQL = {
    "registered": "state IN ('applied', 'skipped') OR shop_id % 11 = 0",
    "excluded": "state = 'excluded'",
    "held": "state = 'held'",
    "url_conflict": "state = 'url_conflict' OR shop_id % 13 = 0",
    "unregistered": "state = 'pending'",
}


@query(f"""WITH s AS (SELECT shop_id, CASE shop_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'applied' WHEN 2 THEN 'excluded' WHEN 3 THEN 'held' WHEN 4 THEN 'url_conflict' ELSE 'skipped' END AS state FROM b_shop),
m AS ({' UNION ALL '.join(f"SELECT shop_id, '{k}' AS tab FROM s WHERE {v}" for k, v in _TAB_SQL.items())}) SELECT shop_id, count(*) AS n, min(tab) AS first, max(tab) AS last FROM m GROUP BY 1 HAVING count(*) > 1""")
def v04_no_overlap(t: Tables):
    """Records that the conditions of more than one tab hold for, with how many; the order of the tabs decides between them."""
    k = F.col("shop_id") % 6
    state = F.when(k == 0, "pending").when(k == 1, "applied").when(k == 2, "excluded").when(k == 3, "held").when(k == 4, "url_conflict").otherwise("skipped")
    rows = t.shop.select("shop_id", state.alias("state"))
    tabs = review.tab_conditions(F.col("state"), F.lit("review"), F.col("shop_id") % 11 == 0, F.col("shop_id") % 13 == 0)
    return review.in_several_tabs(rows, "shop_id", tabs)


@query()
def j16_variant_similarity(t: Tables):
    """Highest similarity over name variants of neighbouring records of a street."""
    from placeworks.functions.text import name_variants
    from placeworks.operators.joins import variant_similarity

    a = t.record.alias("a")
    b = t.record.select((F.col("id") - 1).alias("id"), F.col("name").alias("other")).alias("b")
    return a.join(b, "id").select("id", variant_similarity(name_variants(F.col("name")), name_variants(F.col("other")), similarity).alias("like"))
