"""Scalar functions over columns of the tables (T, D, M, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeworks.functions import arrays as A
from placeworks.functions import geo as G
from placeworks.functions import text as T
from placeworks.functions import times as D
from placeworks.plans.registry import query
from placeworks.plans.roles import Tables, today



@query()
def t01_nfkc(t: Tables):
    return t.base("documents").select("doc_id", T.nfkc("text").alias("text"))


@query("SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || '　 x'), '[\\s　]+', ' ', 'g')) AS name FROM part")
def t02_squeeze(t: Tables):
    return t.base("part").select("p_partkey", T.squeeze(F.concat(F.lit("  "), "p_name", F.lit("　 x"))).alias("name"))


@query("SELECT p_partkey, p_name || ' A1!' AS name FROM part")
def t03_half_width(t: Tables):
    return t.base("part").select("p_partkey", T.half_width(F.concat("p_name", F.lit("　Ａ１！"))).alias("name"))


@query("SELECT p_partkey, regexp_replace(p_name, 'e', '', 'g') || 'ab' AS name FROM part")
def t04_without_punctuation(t: Tables):
    return t.base("part").select("p_partkey", T.without_punctuation(F.concat(F.regexp_replace("p_name", "e", "・"), F.lit("(a)-b"))).alias("name"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[\\s]+', '', 'g') || 'a1' AS key FROM part")
def t05_duplicate_key(t: Tables):
    return t.base("part").select("p_partkey", T.duplicate_key(F.concat("p_name", F.lit("　（Ａ）-１"))).alias("key"))


@query("SELECT p_partkey, trim(regexp_replace(p_name, ' [a-z]+$', '')) AS name FROM part")
def t08_core_name(t: Tables):
    return t.base("part").select("p_partkey", T.core_name(F.col("p_name"), [r" [a-z]+$", r"[(（].*[)）]$"]).alias("name"))


@query("SELECT c_custkey, nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), '') AS digits FROM customer")
def t09_digits(t: Tables):
    return t.base("customer").select("c_custkey", T.digits(F.col("c_name")).alias("digits"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '梅田ビル2f' ELSE '大阪府大阪市北区梅田' || CAST(c_custkey % 30 + 1 AS VARCHAR) || '-' || CAST(c_custkey % 7 + 1 AS VARCHAR) || CASE WHEN c_custkey % 5 = 1 THEN '' ELSE '-3' END END AS street,
CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN 'サンパーク2f' ELSE '第1-2号館' END AS building, c_custkey % 5 <> 0 AS complete FROM customer""")
def t10_address_parts(t: Tables):
    """Addresses with a lot that ends at 号, with one that goes on to the building, and without one."""
    k = F.col("c_custkey")
    numbers = F.concat((k % 30 + 1).cast("string"), F.lit("丁目"), (k % 7 + 1).cast("string"))
    address = F.when(k % 5 == 0, "〒530-0001 梅田 ビル２Ｆ").when(k % 5 == 1, F.concat(F.lit("大阪府大阪市北区梅田"), numbers, F.lit(" サンパーク２Ｆ"))).otherwise(F.concat(F.lit("〒530-0001 大阪府大阪市北区 梅田"), numbers, F.lit("番三号 第1-2号館")))
    return t.base("customer").select("c_custkey", T.address_parts(address).alias("p")).select("c_custkey", "p.*")


@query("SELECT c_custkey, 'X市北区' || CAST(c_custkey AS VARCHAR) AS rest, 'X市北区' AS municipality FROM customer")
def t12_municipality(t: Tables):
    address = F.concat(F.lit("〒530-0001 X市北区"), F.col("c_custkey").cast("string"))
    return t.base("customer").select("c_custkey", T.without_postal_prefix(address).alias("rest"), T.municipality(address).alias("municipality"))


@query("""SELECT c_custkey, CAST(CASE WHEN k = 0 THEN NULL ELSE k END AS INTEGER) AS n FROM (SELECT c_custkey, c_custkey % 100 AS k FROM customer)""")
def t13_kanji_number(t: Tables):
    numerals = F.lit("一二三四五六七八九")
    k = F.col("c_custkey") % 100
    tens, ones = F.floor(k / 10).cast("int"), (k % 10).cast("int")
    digit = lambda n: F.when(n > 0, F.substring(numerals, n, F.lit(1))).otherwise("")
    written = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), digit(ones))
    return t.base("customer").select("c_custkey", T.kanji_number(written).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 4 END AS n, CASE WHEN c_custkey % 2 = 0 THEN 'ab' ELSE 'abc' END AS rest FROM customer")
def t16_common_suffix(t: Tables):
    a = F.when(F.col("c_custkey") % 2 == 0, "ab北浜駅前店").otherwise("abc浜駅前店")
    return t.base("customer").select("c_custkey", T.common_suffix_length(a, F.lit("xy北浜駅前店")).cast("int").alias("n"), T.without_common_branch(a, F.lit("xy北浜駅前店")).alias("rest"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [p_name || '(Bar)', p_name] ELSE [p_name] END AS variants FROM part")
def t17_variants(t: Tables):
    return t.base("part").select("p_partkey", T.name_variants(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("(Bar)"))).otherwise(F.col("p_name"))).alias("variants"))


@query("SELECT c_custkey, ['3', 'b' || CAST(c_custkey % 3 + 1 AS VARCHAR)] AS floors FROM customer")
def t18_floors(t: Tables):
    return t.base("customer").select("c_custkey", T.floors(F.concat(F.lit("x ３階 / B"), (F.col("c_custkey") % 3 + 1).cast("string"), F.lit("F / 10 units"))).alias("floors"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), '^https?://[^/?#@]+') THEN 'https://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') END AS url FROM pages""")
def t19_canonical_url(t: Tables):
    return t.base("pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("SELECT p_partkey, 'https://x.example/?u=' || replace(url_encode(p_name), '%20', '+') AS link FROM part")
def t20_template(t: Tables):
    return t.base("part").select("p_partkey", T.into_template("https://x.example/?u={url}", F.col("p_name")).alias("link"))


@query("SELECT p_partkey, 'https://x.example/p?a=1&b=' || CAST(p_partkey AS VARCHAR) || '&ref=new' AS link FROM part")
def t21_query_param(t: Tables):
    url = F.concat(F.lit("https://x.example/p?a=1&ref=old&b="), F.col("p_partkey").cast("string"))
    return t.base("part").select("p_partkey", T.with_query_param(url, "ref", F.lit("new")).alias("link"))


@query("SELECT p_partkey, [p_partkey, 7::BIGINT] AS ids FROM part")
def t22_shortcodes(t: Tables):
    return t.base("part").select("p_partkey", T.shortcode_ids(F.concat(F.lit('x [shop id="'), F.col("p_partkey").cast("string"), F.lit('"] y [SHOP id=7 ]'))).alias("ids"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 1 THEN CASE WHEN p_size <= 1 THEN p_size * 100.0e0 ELSE CAST(p_size AS DOUBLE) END ELSE 0.0e0 END AS percent FROM part")
def t25_percent(t: Tables):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.col("p_size").cast("string"), F.lit("%"))).when(k == 1, F.col("p_size").cast("string")).otherwise("n/a")
    return t.base("part").select("p_partkey", T.percent(text).alias("percent"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def t26_slug(t: Tables):
    return t.base("part").select("p_partkey", T.slug(F.concat("p_name", F.lit("!"))).alias("slug"))


@query("SELECT o_orderkey, substr(sha256('SELECT ? FROM ' || o_orderstatus || ' WHERE id = ? AND ' || replace(o_orderpriority, left(o_orderpriority, 1), '?') || ' = ?'), 1, 16) AS fingerprint FROM orders")
def t27_sql_fingerprint(t: Tables):
    """Statements of as many forms as there are statuses and priorities, with literals and comments of each order."""
    text = F.concat(F.lit("SELECT 'it''s'  FROM "), "o_orderstatus", F.lit(" /* "), "o_clerk" if "o_clerk" in t.base("orders").columns else F.lit("c"), F.lit(" */ WHERE id = "), F.col("o_orderkey").cast("string"), F.lit(" AND "), "o_orderpriority", F.lit(" = 1.5"))
    return t.base("orders").select("o_orderkey", T.sql_fingerprint(text).alias("fingerprint"))


@query("SELECT fingerprint, count(*) AS n, CAST(sum(o_orderkey % 100) AS BIGINT) AS total, max(o_orderkey % 100) AS worst FROM (SELECT o_orderkey, substr(sha256('SELECT ? FROM ' || o_orderstatus), 1, 16) AS fingerprint FROM orders) GROUP BY 1 ORDER BY total DESC, fingerprint LIMIT 10")
def q38_statement_log(t: Tables):
    """The most costly statements by fingerprint."""
    text = F.concat(F.lit("SELECT "), F.col("o_orderkey").cast("string"), F.lit(" FROM "), "o_orderstatus")
    cost = F.col("o_orderkey") % 100
    rows = t.base("orders").groupBy(T.sql_fingerprint(text).alias("fingerprint")).agg(F.count("*").alias("n"), F.sum(cost).alias("total"), F.max(cost).alias("worst"))
    return rows.orderBy(F.desc("total"), "fingerprint").limit(10)


@query("SELECT c_custkey, '北浜駅' AS station FROM customer")
def t28_nearest_station(t: Tables):
    text = F.concat(F.lit("淀屋橋駅 徒歩"), (F.col("c_custkey") % 5 + 6).cast("string"), F.lit("分\n北浜駅 徒歩5分\n南森町駅 900m"))
    return t.base("customer").select("c_custkey", T.nearest_station(text).alias("station"))


@query("SELECT p_partkey, '/shops/:id/edit' AS route FROM part")
def t29_route(t: Tables):
    return t.base("part").select("p_partkey", T.route(F.concat(F.lit("/shops/"), F.col("p_partkey").cast("string"), F.lit("/edit"))).alias("route"))


@query("SELECT c_custkey, '06-1234-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone FROM customer")
def t30_phone(t: Tables):
    text = F.concat(F.lit("TEL：06-1234-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit(" まで"))
    return t.base("customer").select("c_custkey", T.phone(text).alias("phone"))


@query("SELECT c_custkey, concat_ws(' ', CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_mktsegment) AS label FROM customer")
def t31_join_present(t: Tables):
    return t.base("customer").select("c_custkey", T.join_present(" ", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("　 "), F.col("c_mktsegment")).alias("label"))


@query("SELECT c_custkey, 'ab' AS prefix, '1' AS was, '22' AS now, 'yz' AS suffix FROM customer")
def t32_difference(t: Tables):
    return t.base("customer").select("c_custkey", T.difference(F.lit("ab1yz"), F.lit("ab22yz")).alias("d")).select("c_custkey", "d.prefix", F.col("d.left").alias("was"), F.col("d.right").alias("now"), "d.suffix")


@query("""SELECT shop_id, CASE WHEN last_confirmed_on IS NULL THEN 'never' WHEN n <= 30 THEN '30' WHEN n <= 90 THEN '90' WHEN n <= 180 THEN '180' WHEN n <= 365 THEN '365' ELSE 'older' END AS bucket FROM (SELECT *, DATE '2024-01-31' - last_confirmed_on AS n FROM b_shop)""")
def d01_age_bucket(t: Tables):
    return t.shop.select("shop_id", D.age_bucket(today(), F.col("last_confirmed_on")).alias("bucket"))


@query("SELECT o_orderkey, CASE WHEN m < 60 AND h * 60 + m <= 1440 THEN CAST(h * 60 + m AS INTEGER) END AS minute, CASE WHEN m < 60 THEN CAST(h * 60 + m AS INTEGER) END AS long_minute FROM (SELECT o_orderkey, o_orderkey % 30 AS h, o_orderkey % 70 AS m FROM orders)")
def d03_minutes(t: Tables):
    clock = F.concat((F.col("o_orderkey") % 30).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 70).cast("string"), 2, "0"))
    return t.base("orders").select("o_orderkey", D.minutes(clock).alias("minute"), D.long_minutes(clock).alias("long_minute"))


@query("SELECT o_orderkey, CAST(dayofweek(o_orderdate) AS INTEGER) AS weekday FROM orders")
def d05_weekday(t: Tables):
    return t.base("orders").select("o_orderkey", D.weekday(F.col("o_orderdate")).alias("weekday"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN DATE '2024-01-31' ELSE CAST(o_orderdate AS DATE) END AS day FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' OR o_orderkey % 3 > 0")
def d06_loose_date(t: Tables):
    k, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "yyMMdd")).when(k == 1, F.date_format(day, "yyyy/MM/dd")).otherwise("soon")
    rows = t.base("orders").filter((day >= F.lit("2000-01-01").cast("timestamp_ntz")) | (k > 0))
    return rows.select("o_orderkey", D.loose_date(text, today()).alias("day"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + to_minutes(CASE WHEN c <= o THEN c + 1440 ELSE c END) AS closes FROM (SELECT o_orderkey, o_orderdate, (o_orderkey * 37) % 1441 AS o, (o_orderkey * 53) % 1441 AS c FROM orders)")
def d07_closing_instant(t: Tables):
    k = F.col("o_orderkey")
    return t.base("orders").select(k, D.closing_instant(F.to_date("o_orderdate"), k * 37 % 1441, k * 53 % 1441).alias("closes"))


@query("SELECT o_orderkey, CASE WHEN c - 1000 > 0 AND c - 1000 <= 120 THEN CAST(c - 1000 AS BIGINT) END AS closing FROM (SELECT o_orderkey, (o_orderkey * 53) % 1441 AS c FROM orders)")
def d08_closing_soon(t: Tables):
    return t.base("orders").select("o_orderkey", D.closing_soon(F.lit(1000), F.col("o_orderkey") * 53 % 1441).alias("closing"))


@query("SELECT event_id, CAST(1700000000 + event_id AS BIGINT) AS seconds FROM events")
def d09_epoch_seconds(t: Tables):
    k = F.col("event_id")
    raw = (F.lit(1700000000).cast("long") + k) * F.when(k % 3 == 0, F.lit(1).cast("long")).when(k % 3 == 1, F.lit(1000).cast("long")).otherwise(F.lit(1000000).cast("long"))
    return t.base("events").select(k, D.epoch_seconds(raw).alias("seconds"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM events")
def d10_iso_micros(t: Tables):
    return t.base("events").select("event_id", D.iso_micros(F.col("ts")).alias("at"))


@query("SELECT event_id, sha256(CAST(user_id AS VARCHAR) || '|' || event_type || '|' || 's' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS visitor FROM events")
def d11_visitor_hash(t: Tables):
    return t.base("events").select("event_id", D.visitor_hash(F.col("user_id").cast("string"), F.col("event_type"), "s", F.to_date("ts")).alias("visitor"))


@query("SELECT c_custkey, CAST(greatest(least(c_custkey % 300 - 100, 100), 0) AS BIGINT) AS score FROM customer")
def m05_clamp(t: Tables):
    return t.base("customer").select("c_custkey", G.clamp(F.col("c_custkey") % 300 - 100, 0, 100).cast("long").alias("score"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN floor(c_custkey % 7 * 100.0e0 / (c_custkey % 4) * 10 + 0.5e0) / 10.0e0 ELSE 0.0e0 END AS rate FROM customer")
def m06_rate(t: Tables):
    return t.base("customer").select("c_custkey", G.rate(F.col("c_custkey") % 7, F.col("c_custkey") % 4).alias("rate"))


@query("SELECT n_name, CAST(ceil(count(*) / 7.0e0) AS BIGINT) AS pages FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def m08_pages(t: Tables):
    rows = t.base("customer").join(t.base("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(G.pages(F.count("*"), 7).alias("pages"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN sha256(CAST(to_json([c_name, c_mktsegment]) AS VARCHAR)) END AS digest FROM customer")
def m09_identity(t: Tables):
    blank = F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_name"))
    return t.base("customer").select("c_custkey", G.identity_digest(blank, F.col("c_mktsegment")).alias("digest"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1.5e0 WHEN 'MACHINERY' THEN 1.2e0 ELSE 1.0e0 END AS fit FROM customer")
def n01_lookup(t: Tables):
    return t.base("customer").select("c_custkey", A.lookup({"BUILDING": 1.5, "MACHINERY": 1.2}, F.col("c_mktsegment"), 1.0).alias("fit"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red') AND contains(p_name, 'tin') THEN ['tin', 'red'] WHEN contains(p_name, 'red') THEN ['red'] WHEN contains(p_name, 'tin') THEN ['tin'] ELSE [] END AS items FROM part")
def n02_clean_list(t: Tables):
    has = lambda w: F.when(F.contains("p_name", F.lit(w)), f" {w} ").otherwise("")
    return t.base("part").select("p_partkey", A.clean_list(F.array(has("tin"), has("red"), has("red"), F.lit("other"), F.lit(" ")), ["red", "tin"]).alias("items"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS closed, CASE WHEN c_custkey % 2 = 1 THEN '09:00' END AS opens FROM customer")
def n03_schedule(t: Tables):
    json = F.concat(F.lit('{"monday":{"closed":'), (F.col("c_custkey") % 2 == 0).cast("string"), F.lit(',"open":"09:00","close":"18:00","break_enabled":true,"break_start":"12:00"},"tuesday":{"open":"10:00"}}'))
    return t.base("customer").select("c_custkey", A.schedule(json).alias("s")).select("c_custkey", F.col("s.monday.closed").alias("closed"), F.col("s.monday.open").alias("opens"))


@query("SELECT c_custkey, lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') || ':00-23:30' AS monday FROM customer")
def n04_schedule_of_text(t: Tables):
    text = F.concat(F.lit("Monday: "), F.lpad((F.col("c_custkey") % 24).cast("string"), 2, "0"), F.lit(":00 - 23:30\nTuesday closed"))
    return t.base("customer").select("c_custkey", A.schedule_of_text(text)["monday"].alias("monday"))


@query("SELECT c_custkey, c_custkey % 4 IN (0, 1) AS yes FROM customer")
def n06_truthy(t: Tables):
    k = F.col("c_custkey") % 4
    return t.base("customer").select("c_custkey", A.truthy(F.when(k == 0, " TRUE ").when(k == 1, "1").when(k == 2, "no")).alias("yes"))


@query("SELECT c_custkey, [CAST((c_custkey + i) % 7 AS BIGINT) FOR i IN range(0, 1 + (c_custkey % 5 - c_custkey % 7 + 7) % 7)] AS days FROM customer")
def n07_day_range(t: Tables):
    k = F.col("c_custkey")
    return t.base("customer").select(k, A.day_range(k % 7, k % 5).alias("days"))


@query("SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['red', 'tin']) AS some, len(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('red', 'tin'))) = 0 AS every FROM part")
def n08_any_all(t: Tables):
    words = F.split("p_name", " ")
    return t.base("part").select("p_partkey", A.any_of(words, ["red", "tin"]).alias("some"), A.all_of(words, ["red", "tin"]).alias("every"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def n10_dig(t: Tables):
    return t.base("events").select("event_id", A.dig(F.col("props"), "k").cast("long").alias("k"))


@query()
def x11_page_evidence(t: Tables):
    """Name found in each page."""
    from placeworks.sources import evidence

    return evidence(t.base("pages")).select("page_id", "evidence.name", "evidence.records")


@query("SELECT c_custkey, 'Tokyo' AS place, CASE WHEN c_custkey % 2 = 0 THEN 'sqlite' END AS tag FROM customer")
def n09_only_keys(t: Tables):
    m = F.create_map(F.lit("place"), F.lit("Tokyo"), F.lit("tag"), F.when(F.col("c_custkey") % 2 == 0, "sqlite"), F.lit("secret"), F.lit("x"))
    return t.base("customer").select("c_custkey", A.only_keys(m, ["place", "tag"]).alias("m")).select("c_custkey", F.col("m.place").alias("place"), F.col("m.tag").alias("tag"))
