"""Classes, normal forms and extraction over the texts of the tables: documents, conversations and page addresses are what the rules read, and SQL
applies the same rules to the same texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeworks.functions import arrays as A
from placeworks.functions import classify as C
from placeworks.functions import hours as H
from placeworks.functions import pasted as X
from placeworks.functions import scores as S
from placeworks.functions import text as T
from placeworks.operators import linkage as L
from placeworks.operators import pasted
from placeworks.operators import predicates as P
from placeworks.plans.registry import query
from placeworks.plans.roles import Tables

_PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"


def _path() -> Column:
    return F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def _turns(t: Tables):
    """Texts of conversations with that of the turn before."""
    v = t.base("conversations").select("conv_id", "turn", "text")
    before = v.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("was"))
    return v.join(before, ["conv_id", "turn"])


_TURNS = "b AS (SELECT v.conv_id, v.turn, v.text, w.text AS was FROM conversations v JOIN conversations w ON v.conv_id = w.conv_id AND v.turn = w.turn + 1)"
_KEY = "sha256(regexp_replace({0}, '[\\s　]+', '', 'g'))"


@query(f"""WITH n AS (SELECT conv_id, turn, regexp_replace(lower(nfc_normalize(text)), '[\\s　]+', '', 'g') AS k FROM conversations) SELECT conv_id, turn, sha256(k) AS linkage, sha256(regexp_replace(k, '[・･''’"“”()（）\\-‐–—ー]', '', 'g')) AS lookup FROM n""")
def t06_names_of_texts(t: Tables):
    """Normal forms for linkage and lookup of whole texts (T06, T07), by their digests."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return t.base("conversations").select("conv_id", "turn", digest(T.linkage_name(F.col("text"))).alias("linkage"), digest(T.lookup_name(F.col("text"))).alias("lookup"))


@query("""SELECT doc_id, regexp_replace(CASE doc_id % 4 WHEN 0 THEN '〒' WHEN 1 THEN '日本、〒' WHEN 2 THEN ' ' ELSE '日本 ' END || CASE WHEN n_chars % 3 > 0 THEN lpad(CAST(n_chars % 1000 AS VARCHAR), 3, '0') || CASE WHEN n_chars % 3 = 1 THEN '-' ELSE '' END || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') ELSE '' END || ' ' || text,
'^\\s*(?:日本[、,]?\\s*)?(?:〒\\s*)?(?:\\d{3}-?\\d{4})?\\s*', '') AS rest FROM documents""")
def t11_prefixes_of_texts(t: Tables):
    """Country, postal mark and code in several forms in front of each text."""
    k, n = F.col("doc_id"), F.col("n_chars")
    mark = F.when(k % 4 == 0, "〒").when(k % 4 == 1, "日本、〒").when(k % 4 == 2, " ").otherwise("日本 ")
    code = F.when(n % 3 > 0, F.concat(F.lpad((n % 1000).cast("string"), 3, "0"), F.when(n % 3 == 1, "-").otherwise(""), F.lpad((k % 10000).cast("string"), 4, "0"))).otherwise("")
    return t.base("documents").select("doc_id", T.without_postal_prefix(F.concat(mark, code, F.lit(" "), "text")).alias("rest"))


_SUFFIX = "coalesce(list_max([i FOR i IN range(1, least(length(a), length(b)) + 1) IF right(a, CAST(i AS INTEGER)) = right(b, CAST(i AS INTEGER))]), 0)"
_PREFIX = "coalesce(list_max([i FOR i IN range(1, least(length(a), length(b)) + 1) IF left(a, CAST(i AS INTEGER)) = left(b, CAST(i AS INTEGER))]), 0)"


@query(f"""WITH {_TURNS}, s AS (SELECT conv_id, turn, text || '駅前店' AS a, was || '駅前店' AS b FROM b), k AS (SELECT *, {_SUFFIX} AS n FROM s)
SELECT conv_id, turn, CAST(n AS INTEGER) AS n, CASE WHEN n >= 4 THEN left(a, length(a) - CAST(n AS INTEGER)) ELSE a END AS rest FROM k""")
def t16_suffix_of_turns(t: Tables):
    """Common ending of each turn and the one before, with a branch name behind both."""
    rows = _turns(t).select("conv_id", "turn", F.concat("text", F.lit("駅前店")).alias("a"), F.concat("was", F.lit("駅前店")).alias("b"))
    return rows.select("conv_id", "turn", T.common_suffix_length(F.col("a"), F.col("b")).cast("int").alias("n"), T.without_common_branch(F.col("a"), F.col("b")).alias("rest"))


@query("""SELECT doc_id, list_sort(list_distinct([CAST(n_chars % 30 + 1 AS VARCHAR), 'b' || CAST(doc_id % 3 + 1 AS VARCHAR)])) AS floors FROM documents""")
def t18_floors_in_texts(t: Tables):
    """Two floors among the letters of each text: a number and a basement."""
    words = F.regexp_replace("text", r"[^\p{L}\n ]", "")
    text = F.concat(words, F.lit(" ／"), (F.col("n_chars") % 30 + 1).cast("string"), F.lit("階 "), words, F.lit(" (Ｂ"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("Ｆ）"))
    return t.base("documents").select("doc_id", T.floors(text).alias("floors"))


@query("""SELECT page_id, split_part(url, '?', 1) || '?' || array_to_string(list_filter(string_split(CASE WHEN contains(url, '?') THEN list_last(string_split(url, '?')) ELSE '' END, '&'), lambda x: x <> '' AND NOT starts_with(x, 'ref=')) || ['ref=' || CAST(page_id AS VARCHAR)], '&') AS link FROM pages""")
def t21_param_of_addresses(t: Tables):
    return t.base("pages").select("page_id", T.with_query_param(F.col("url"), "ref", F.col("page_id").cast("string")).alias("link"))


@query("SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN [n_chars, doc_id] WHEN n_chars % 3 = 1 THEN [doc_id] ELSE [] END AS ids FROM documents")
def t22_shortcodes_in_texts(t: Tables):
    """Codes in several spellings among the words of each text, and one that is none."""
    n, k = F.col("n_chars"), F.col("doc_id").cast("string")
    first = F.when(n % 3 == 0, F.concat(F.lit('[shop id="'), n.cast("string"), F.lit('"]'))).otherwise("[shop no=1]")
    second = F.when(n % 3 < 2, F.concat(F.lit("[SHOP  id='"), k, F.lit("' ]"))).otherwise("[shop id=x]")
    return t.base("documents").select("doc_id", T.shortcode_ids(F.concat("text", first, "text", second)).alias("ids"))


@query("""SELECT doc_id, CASE WHEN a <= b THEN CASE WHEN n_chars % 2 = 0 OR a < b THEN 'a駅' ELSE 'b駅' END ELSE 'b駅' END AS station FROM (SELECT doc_id, n_chars, n_chars % 17 + 1 AS a, doc_id % 13 + 1 AS b FROM documents) WHERE a <> b""")
def t28_station_of_lines(t: Tables):
    """The nearest of two stations on foot, with a third one by metres, in either order, below the lines of a text."""
    rows = t.base("documents").select("doc_id", "n_chars", F.regexp_replace("text", "[^a-z\n]", "").alias("words"), (F.col("n_chars") % 17 + 1).alias("a"), (F.col("doc_id") % 13 + 1).alias("b")).filter("a != b")
    line = lambda name, n: F.concat(F.lit(f"{name}駅 徒歩"), n.cast("string"), F.lit("分"))
    both = F.when(F.col("n_chars") % 2 == 0, F.concat_ws("\n", line("a", F.col("a")), line("b", F.col("b")))).otherwise(F.concat_ws("\n", line("b", F.col("b")), line("a", F.col("a"))))
    return rows.select("doc_id", T.nearest_station(F.concat("words", F.lit("\n"), both, F.lit("\nc駅 50m"))).alias("station"))


@query(f"SELECT page_id, regexp_replace(regexp_replace({_PATH} || '/', '/[0-9]+/', '/:id/', 'g'), '/$', '') AS route FROM pages")
def t29_route_of_addresses(t: Tables):
    return t.base("pages").select("page_id", T.route(_path()).alias("route"))


@query("""SELECT doc_id, nullif(regexp_extract(text, '(?:^|[^0-9])(0[0-9]{1,4}-[0-9]{1,4}-[0-9]{3,4}|0[0-9]{9,10})(?:[^0-9]|$)', 1), '') AS phone FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 > 0 THEN ' 0' || CAST(doc_id % 9 + 1 AS VARCHAR) || '-' || lpad(CAST(n_chars % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') ELSE '' END AS text FROM documents)""")
def t30_phone_in_texts(t: Tables):
    """The first phone number of each text, most of which have one at their end."""
    k, n = F.col("doc_id"), F.col("n_chars")
    digits = lambda x: F.lpad((x % 10000).cast("string"), 4, "0")
    tail = F.when(k % 3 > 0, F.concat(F.lit(" ０"), (k % 9 + 1).cast("string"), F.lit("－"), digits(n), F.lit("-"), digits(k))).otherwise("")
    return t.base("documents").select("doc_id", T.phone(F.concat("text", tail)).alias("phone"))


@query(f"""WITH {_TURNS}, s AS (SELECT conv_id, turn, was AS a, text AS b FROM b), h AS (SELECT *, CAST({_PREFIX} AS INTEGER) AS h, CAST({_SUFFIX} AS INTEGER) AS e FROM s), d AS (SELECT *, least(e, least(length(a), length(b)) - h) AS t FROM h)
SELECT conv_id, turn, left(a, h) AS prefix, substr(a, h + 1, length(a) - h - t) AS was, substr(b, h + 1, length(b) - h - t) AS now, right(a, CAST(t AS INTEGER)) AS suffix FROM d""")
def t32_difference_of_turns(t: Tables):
    """What each turn has in common with the one before at both ends, and what differs."""
    return _turns(t).select("conv_id", "turn", T.difference(F.col("was"), F.col("text")).alias("d")).select("conv_id", "turn", "d.prefix", F.col("d.left").alias("was"), F.col("d.right").alias("now"), "d.suffix")


@query(f"SELECT doc_id, regexp_matches(lower(text), '{'|'.join(P.BOTS)}') AS bot FROM documents")
def f24_marks_in_texts(t: Tables):
    """The marks of automated agents, looked for in whole texts."""
    return t.base("documents").select("doc_id", P.is_bot(F.col("text")).alias("bot"))


_FIRST, _SECOND = [("north", "\\bthe\\b|nicht"), ("south", "que|und")], [("west", "er|en")]


def _rules(c: str, rules: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{p}') THEN '{label}'" for label, p in rules) + f" ELSE {default} END"


@query(f"SELECT conv_id, turn, coalesce({_rules('text', _FIRST)}, {_rules('text', _SECOND)}) AS area FROM conversations")
def c01_area_of_turns(t: Tables):
    """The first area whose words a turn holds, then the second pass."""
    return t.base("conversations").select("conv_id", "turn", F.coalesce(T.first_rule(F.col("text"), _FIRST), T.first_rule(F.col("text"), _SECOND)).alias("area"))


_WORDS = "len(list_filter(regexp_split_to_array({0}, '[\\s　]+'), lambda x: x <> ''))"


@query(f"""SELECT conv_id, turn, (contains(low, 'que la') AND NOT contains(low, 'the')) OR (regexp_matches(low, '[&×]') AND NOT contains(low, 'the')) OR regexp_matches(low, '[ａ-ｚＡ-Ｚ]') OR ({_WORDS.format('low')} >= 4 AND NOT regexp_matches(low, 'ung|tion')) AS odd FROM (SELECT conv_id, turn, trim(lower(text)) AS low FROM conversations)""")
def c04_unnatural_turns(t: Tables):
    return t.base("conversations").select("conv_id", "turn", S.unnatural(F.col("text"), "the", "que la", "ung|tion").alias("odd"))


def _has(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text, '\\d+-\\d+') OR {_has('text', ['license'])} THEN true WHEN {_has('text', ['tion', 'lich'])} THEN false WHEN {_has('text', ['eau', 'ent'])} OR regexp_matches(text, 'en\\.$') THEN true ELSE {_WORDS.format('trim(text)')} <= 12 END AS shop FROM documents""")
def c05_texts_like_shops(t: Tables):
    return t.base("documents").select("doc_id", C.looks_like_shop(F.col("text"), r"\d+-\d+", ["license"], ["tion", "lich"], ["eau", "ent"], r"en\.$", 12).alias("shop"))


@query(f"""SELECT doc_id, CASE WHEN {_has('text', ['license', 'http'])} THEN 'brand_check' WHEN {_has('text', ['nicht'])} THEN 'facility' WHEN contains(text, '&') OR (contains(text, 'que') AND NOT contains(text, 'la')) OR n_chars < 200 THEN 'specific_shop' ELSE 'general' END AS kind FROM documents""")
def c06_type_of_texts(t: Tables):
    text = F.col("text")
    return t.base("documents").select("doc_id", C.query_type(text, ["license", "http"], ["nicht"], text.contains("&"), text.contains("que"), text.contains("la"), F.col("n_chars") < 200).alias("kind"))


@query(f"""WITH {_TURNS}, n AS (SELECT conv_id, turn, regexp_replace(lower(nfc_normalize(was)), '[\\s　]+', '', 'g') AS a, regexp_replace(lower(nfc_normalize(text)), '[\\s　]+', '', 'g') AS b FROM b)
SELECT conv_id, turn, coalesce({_rules('a', [('north', 'therth'), ('south', 'quela')])}, {_rules('b', [('north', 'therth'), ('south', 'quela')])}) AS area FROM n""")
def c27_area_of_turns(t: Tables):
    """An area named by the turn before, or else by this one, whatever the spaces."""
    return _turns(t).select("conv_id", "turn", C.area(F.col("was"), F.col("text"), [("north", "therth"), ("south", "quela")]).alias("area"))


@query("""SELECT doc_id, CASE WHEN v IN ('cafe', 'pub', 'The') THEN v ELSE 'other' END AS genre, CASE WHEN v NOT IN ('cafe', 'pub', 'The') THEN w END AS original FROM (SELECT doc_id, w, CASE WHEN starts_with(w, 'De') THEN 'cafe' WHEN starts_with(w, 'Th') AND w <> 'The' THEN 'pub' WHEN w = 'Le' THEN 'pub' ELSE w END AS v FROM (SELECT doc_id, regexp_extract(text, '^[^ ]*') AS w FROM documents))""")
def c28_genre_of_words(t: Tables):
    """Genre of the first word of each text: known beginnings, an alias, a known word, or other with what was written."""
    word = F.regexp_extract("text", "^[^ ]*", 0)
    plain = F.when(word.startswith("Th") & (word != "The"), F.lit("Pub-")).otherwise(word)
    g = C.genre(plain, {"De": "cafe", "Pub-": "pub"}, {"Le": "pub"}, ["cafe", "pub", "The"], "other")
    return t.base("documents").select("doc_id", g["genre"].alias("genre"), F.when(g["original"].isNotNull(), word).alias("original"))


@query("SELECT doc_id, NOT regexp_full_match(coalesce(text, ''), '[\\s　]*') AND NOT contains(lower(text), 'unknown') AND NOT contains(lower(text), 'nicht') AS may FROM documents")
def c31_texts_that_may(t: Tables):
    return t.base("documents").select("doc_id", C.may_be_approved([F.col("text"), F.col("source")], F.col("text"), ["unknown", "nicht"]).alias("may"))


@query("SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 END AS INTEGER) AS code FROM documents")
def c32_code_of_languages(t: Tables):
    return t.base("documents").select("doc_id", C.code(F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")), {"en": 1, "fr": 2, "de": 2}).alias("code"))


_STATEMENTS = [("read", "^(the|de|la)"), ("write", "^(und|in|le)")]


@query(f"SELECT doc_id, {_rules('text', _STATEMENTS, chr(39) + 'other' + chr(39))} AS class FROM documents")
def c33_class_of_texts(t: Tables):
    return t.base("documents").select("doc_id", C.statement_class(F.col("text"), _STATEMENTS).alias("class"))


@query(f"SELECT page_id, CASE WHEN starts_with(p, '/articles') THEN 'article' WHEN starts_with(p, '/shops') THEN 'shop' WHEN regexp_matches(p, '^/[a-z-]+(?:/|$)') THEN 'list' ELSE 'other' END AS kind FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/articles' WHEN 1 THEN '/shops' WHEN 2 THEN '/1' ELSE '' END || {_PATH} AS p FROM pages)")
def c34_type_of_addresses(t: Tables):
    """Types of the paths of page addresses, some below a section of their own."""
    k = F.col("page_id") % 4
    section = F.when(k == 0, "/articles").when(k == 1, "/shops").when(k == 2, "/1").otherwise("")
    return t.base("pages").select("page_id", S.page_type(F.concat(section, _path())).alias("kind"))


_THEMES = [("date", "therth|quela"), ("private", "nicht|eau"), ("night", "lich"), ("pub", "the|que")]


@query(f"SELECT doc_id, CASE WHEN theme IN ('date', 'shisha', 'bar') THEN 'circulation' WHEN theme IN ('private', 'night') THEN 'conversion' ELSE 'search' END AS kind FROM (SELECT doc_id, {_rules('text', _THEMES)} AS theme FROM documents)")
def c35_theme_of_texts(t: Tables):
    return t.base("documents").select("doc_id", S.theme_type(T.first_rule(F.col("text"), _THEMES)).alias("kind"))


@query("SELECT doc_id, (lang IS NULL OR lang = 'de') AND regexp_matches(text, 'nicht.*und') AS restricted FROM documents")
def c36_restricted_texts(t: Tables):
    hours = F.when(F.coalesce(F.col("lang"), F.lit("de")) == "de", "　 ").otherwise("10:00-11:00")
    return t.base("documents").select("doc_id", C.restricted(F.col("text"), hours, "nicht.*und").alias("restricted"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[^a-zA-Z\\n ]', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, l[1] AS name, nullif(array_to_string(l[2:4], chr(10)), '') AS notes, nullif(array_to_string(l[5:], chr(10)), '') AS menu FROM l""")
def x02_fields_of_texts(t: Tables):
    """Labelled fields whose values are the lines of a text: behind a tab, on the lines below, and up to the end of the page."""
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", "[^a-zA-Z\n ]", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = t.base("documents").select("doc_id", lines.alias("l"))
    cut = lambda a, n: F.array_join(F.slice("l", F.lit(a), F.greatest(n, F.lit(0))), "\n")
    page = F.concat(F.lit("Name\t"), F.coalesce(F.get("l", F.lit(0)), F.lit("")), F.lit("\nNotes\n"), cut(2, F.lit(3)), F.lit("\nMenu: "), cut(5, F.size("l") - 4))
    told = rows.select("doc_id", pasted.fields(page, ["Name", "Notes", "Menu"]).alias("f"))
    return told.select("doc_id", *[F.try_element_at("f", F.lit(k)).alias(k.lower()) for k in ("Name", "Notes", "Menu")])


def _letters(c: str = "text") -> Column:
    return F.regexp_replace(c, "[^a-zA-Z\n ]", "")


_LETTERS = "regexp_replace(text, '[^a-zA-Z\\n ]', '', 'g')"
_FMT = "printf('%02d:%02d', CAST({0} // 60 AS INTEGER), CAST({0} % 60 AS INTEGER))"


def _fmt(minute: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minute / 60), minute % 60)


@query(f"""SELECT doc_id, CASE WHEN c OR o THEN c END AS closed, CASE WHEN o AND NOT c THEN {_FMT.format('n_chars % 600')} END AS opens, CASE WHEN c OR o THEN o AND NOT c AND doc_id % 3 = 0 AND n_chars % 2 = 0 END AS rests,
CASE WHEN o AND NOT c AND doc_id % 3 = 0 AND n_chars % 2 = 0 THEN {_FMT.format('(n_chars % 600 + 60)')} END AS break_start FROM (SELECT *, doc_id % 5 = 0 AS c, n_chars % 7 > 0 AS o FROM documents)""")
def n03_schedules_of_rows(t: Tables):
    """JSON schedules with times from the rows, some closed, some without a closing time, some whose break lacks an end."""
    k, n = F.col("doc_id"), F.col("n_chars")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    json = F.concat(
        F.lit('{"monday":{"closed":'), (k % 5 == 0).cast("string"), F.lit(',"open":'), text(_fmt(n % 600)), F.when(n % 7 > 0, F.concat(F.lit(',"close":'), text(_fmt(n % 600 + 600)))).otherwise(""),
        F.lit(',"break_enabled":'), (k % 3 == 0).cast("string"), F.lit(',"break_start":'), text(_fmt(n % 600 + 60)), F.when(n % 2 == 0, F.concat(F.lit(',"break_end":'), text(_fmt(n % 600 + 120)))).otherwise(""), F.lit("}}"),
    )
    s = t.base("documents").select("doc_id", A.schedule(json).alias("s")).select("doc_id", F.try_element_at("s", F.lit("monday")).alias("m"))
    return s.select("doc_id", "m.closed", F.col("m.open").alias("opens"), F.col("m.break_enabled").alias("rests"), "m.break_start")


@query(f"SELECT doc_id, CASE WHEN n_chars % 4 > 0 THEN {_FMT.format('n_chars % 1440')} || '-' || {_FMT.format('doc_id % 1440')} END AS monday, {_FMT.format('doc_id % 1440')} || '-23:30' AS friday FROM documents")
def n04_schedules_in_texts(t: Tables):
    """Lines of hours by day among the lines of a text, in either order and case."""
    k, n = F.col("doc_id"), F.col("n_chars")
    monday = F.when(n % 4 > 0, F.concat(F.lit("  Monday :"), _fmt(n % 1440), F.lit(" -  "), _fmt(k % 1440))).otherwise("monday closed")
    friday = F.concat(F.lit("FRIDAY: "), _fmt(k % 1440), F.lit("-23:30 (last)"))
    text = F.when(k % 2 == 0, F.concat_ws("\n", monday, _letters(), friday)).otherwise(F.concat_ws("\n", friday, monday, _letters()))
    of = lambda day: F.try_element_at("s", F.lit(day)).alias(day)
    return t.base("documents").select("doc_id", A.schedule_of_text(text).alias("s")).select("doc_id", of("monday"), of("friday"))


@query("SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN n_chars % 3 = 0 WHEN lang IS NULL THEN false ELSE doc_id % 4 = 1 END AS yes FROM documents")
def n06_truthy_values(t: Tables):
    """Comparisons and remainders of the rows as text, in capitals and with spaces around."""
    k, n = F.col("doc_id"), F.col("n_chars")
    value = F.when(n % 2 == 0, F.concat(F.lit(" "), F.upper((n % 3 == 0).cast("string")))).when(F.col("lang").isNotNull(), F.concat((k % 4).cast("string"), F.lit(" ")))
    return t.base("documents").select("doc_id", A.truthy(value).alias("yes"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN user_id % 2 = 0 THEN event_type END AS kind FROM events")
def n09_kept_properties(t: Tables):
    """Properties of each event with others added, of which only the named ones are kept."""
    own = F.from_json("props", "map<string,string>")
    more = F.create_map(F.lit("secret"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, "kind").otherwise("other"), F.col("event_type"))
    m = t.base("events").select("event_id", A.only_keys(F.map_concat(own, more), ["k", "kind"]).alias("m"))
    return m.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("kind")).alias("kind"))


_OPENS = "[{'a': 540 + doc_id % 120, 'b': 840 + n_chars % 60}, {'a': 1020 + n_chars % 90, 'b': 1320 + doc_id % 200}]"


@query(f"""WITH r AS (SELECT doc_id, {_OPENS} AS o, 480 + n_chars % 900 AS s, 481 + n_chars % 900 + doc_id % 400 AS e FROM documents),
p AS (SELECT *, list_filter(flatten(list_transform(o, lambda x: CASE WHEN e <= x.a THEN [{{'a': x.a, 'b': least(x.b, s + 1440)}}, {{'a': greatest(x.a, e + 1440), 'b': x.b}}] ELSE [{{'a': x.a, 'b': least(x.b, s)}}, {{'a': greatest(x.a, e), 'b': x.b}}] END)), lambda x: x.a < x.b) AS l FROM r)
SELECT doc_id, list_transform(CASE WHEN len(l) > 0 AND s <= o[1].a THEN [{{'a': l[1].a, 'b': l[-1].b}}] ELSE l END, lambda x: CAST(x.a AS VARCHAR) || '-' || CAST(x.b AS VARCHAR)) AS ranges FROM p WHERE e <= 1439""")
def i09_bans_of_rows(t: Tables):
    """Two openings without a ban, with all times from the rows."""
    k, n = F.col("doc_id"), F.col("n_chars")
    one = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    opens = F.array(one(540 + k % 120, 840 + n % 60), one(1020 + n % 90, 1320 + k % 200))
    start, end = (480 + n % 900).cast("int"), (481 + n % 900 + k % 400).cast("int")
    rows = t.base("documents").filter(end <= 1439)
    return rows.select("doc_id", F.transform(H.without_ban(opens, start, end), lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))).alias("ranges"))


_WITHIN = "CASE WHEN {0} < {1} THEN m >= {0} AND m < {1} ELSE m >= {0} OR m < {1} END"


@query(f"""WITH v AS (SELECT event_id AS k, hour(ts) * 60 + minute(ts) AS m, user_id AS u, CAST(floor(coalesce(value, 0)) AS BIGINT) AS n FROM events),
r AS (SELECT *, n * 7 % 1440 AS a, u * 53 % 1440 AS b, n * 11 % 1440 AS c, u * 31 % 1440 AS d FROM v)
SELECT k AS event_id, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN false WHEN n % 9 = 0 THEN k % 3 <> 0 WHEN n % 9 = 1 THEN {_WITHIN.format('a', 'b')} WHEN n % 6 = 0 THEN false
WHEN k % 7 = 0 THEN n % 4 <> 0 AND {_WITHIN.format('c', 'd')} ELSE n % 6 <> 1 AND {_WITHIN.format('a', 'b')} END AS allowed FROM r""")
def i07_smoking_at_events(t: Tables):
    """Whether smoking is allowed at the time of day of each event: lines by day in either order, times from the row, Mondays banned or without a
    line, holidays without hours, texts without days and blank ones."""
    k, u, n = F.col("event_id"), F.col("user_id"), F.floor(F.coalesce("value", F.lit(0.0))).cast("long")
    span = lambda a, b: F.concat(_fmt(a % 1440), F.lit("-"), _fmt(b % 1440))
    monday = F.when(n % 6 == 0, "月 喫煙不可").when(n % 6 != 1, F.concat(F.lit("月 "), span(n * 7, u * 53)))
    holiday = F.concat(F.lit("祝日 "), F.when(n % 4 == 0, "未設定").otherwise(span(n * 11, u * 31)))
    other = F.lit("火 00:00-23:59")
    days = F.when(u % 2 == 0, F.concat_ws("\n", other, monday, holiday)).otherwise(F.concat_ws("\n", holiday, other, monday))
    text = F.when(n % 9 == 0, " ").when(n % 9 == 1, span(n * 7, u * 53)).otherwise(days)
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("int")
    return t.base("events").select("event_id", H.smoking_now(k % 11 != 0, k % 13 == 0, k % 3 == 0, text, "月", k % 7 == 0, minute).alias("allowed"))


@query("""WITH v AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, user_id AS u, CAST(floor(coalesce(value, 0)) AS BIGINT) AS n FROM events),
r AS (SELECT event_id, m, unnest([{'a': 480 + n % 300, 'b': 800 + u % 100}, {'a': 1020 + n % 200, 'b': (1200 + n * 3) % 1440}, {'a': u % 1300 - 1440, 'b': (300 + u * 11) % 1440 - 1440}]) AS x FROM v)
SELECT event_id, bool_or(m >= x.a AND m < x.b + CASE WHEN x.b <= x.a THEN 1440 ELSE 0 END) AS inside FROM r GROUP BY event_id""")
def i08_spill_of_events(t: Tables):
    """The time of day of each event against a day and a night of today and the hours of yesterday, with all times from the row;
    the SQL counts minutes on one line, on which yesterday is a day earlier."""
    u, n = F.col("user_id"), F.floor(F.coalesce("value", F.lit(0.0))).cast("long")
    one = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    today = F.array(one(480 + n % 300, 800 + u % 100), one(1020 + n % 200, (1200 + n * 3) % 1440))
    yesterday = F.array(one(u % 1300, (300 + u * 11) % 1440))
    minute = F.hour("ts") * 60 + F.minute("ts")
    return t.base("events").select("event_id", H.with_spill(today, yesterday, minute).alias("inside"))


@query(f"""SELECT doc_id, CASE WHEN k <> '' THEN sha256('["' || k || '","' || '梅田' || CAST(n_chars % 9 + 1 AS VARCHAR) || '-' || CAST(doc_id % 20 + 1 AS VARCHAR) || '|' || coalesce(lang, 'x') || '"]') END AS identity FROM (SELECT *, regexp_replace(lower({_LETTERS}), '[\\s　]+', '', 'g') AS k FROM documents)""")
def e01_identity_of_texts(t: Tables):
    """The digest of a name, which is the letters of the text, and an address with numbers from its row; null where no letter is left."""
    address = F.concat(F.lit("〒530-0001 梅田"), (F.col("n_chars") % 9 + 1).cast("string"), F.lit("丁目"), (F.col("doc_id") % 20 + 1).cast("string"), F.lit("番 "), F.coalesce("lang", F.lit("x")))
    p = t.base("documents").select("doc_id", _letters().alias("name"), T.address_parts(address).alias("p"))
    digest = F.sha2(F.to_json(F.array(T.linkage_name(F.col("name")), F.concat_ws("|", "p.street", F.coalesce("p.building", F.lit(""))))), 256)
    return p.select("doc_id", F.when(~T.is_blank(F.col("name")) & F.col("p.street").isNotNull(), digest).alias("identity"))


@query("""SELECT a.doc_id, a.n_chars % 5 > 0 AND a.lang = b.lang AND a.n_chars % 3 = b.n_chars % 3 AND (a.doc_id % 4 = 0 OR a.n_chars % 2 = b.n_chars % 2) AS matches FROM documents a JOIN documents b ON a.doc_id = b.doc_id - 1 WHERE a.lang IS NOT NULL AND b.lang IS NOT NULL""")
def e15_strict_neighbours(t: Tables):
    """Strict matches of each document and the next: language as name, an address and a phone from their sizes."""
    d = t.base("documents").filter("lang is not null")
    a, b = d.alias("a"), d.withColumn("doc_id", F.col("doc_id") - 1).alias("b")
    address = lambda p: F.concat(F.lit("x 1-"), (F.col(f"{p}.n_chars") % 3).cast("string"))
    phone = lambda p: F.concat(F.lit("06"), (F.col(f"{p}.n_chars") % 2).cast("string"))
    match = L.strict_match(F.col("a.n_chars") % 5 == 0, F.col("a.lang"), F.col("b.lang"), address("a"), address("b"), F.when(F.col("a.doc_id") % 4 > 0, phone("a")), phone("b"))
    return a.join(b, "doc_id").select("doc_id", match.alias("matches"))


@query(f"""WITH {_TURNS}, h AS (SELECT conv_id, turn, regexp_extract(lower(was), '^[^ ]*') AS word, lower(text) AS low, text FROM b), s AS (SELECT conv_id, turn,
CASE WHEN word <> '' AND contains(low, word || ' ') THEN 55 ELSE 0 END + CASE WHEN word <> '' AND contains(low, word) THEN 45 ELSE 0 END + CASE WHEN contains(text, 'que') THEN 20 ELSE 0 END + CASE WHEN contains(text, 'the') THEN 15 ELSE 0 END + CASE WHEN contains(text, 'und') THEN 10 ELSE 0 END AS score FROM h)
SELECT conv_id AS target, arg_max(turn, (score, -turn)) AS hit, CAST(max(score) AS INTEGER) AS score FROM s WHERE score >= 30 GROUP BY 1""")
def e17_best_turns(t: Tables):
    """The turn of each conversation that answers the one before best: its first word and known words count."""
    word = F.regexp_extract(F.lower("was"), "^[^ ]*", 0)
    name = F.when(word != "", F.concat(word, F.lit(" "))).otherwise("")
    text = F.col("text")
    score = S.hit_score(name, word, F.lit("que"), text, text, text, ["the"], "und")
    return L.best_hit(_turns(t).select(F.col("conv_id").alias("target"), F.col("turn").alias("hit"), score.cast("int").alias("score")))


@query("""SELECT doc_id, '大阪府大阪市' || coalesce(lang, 'x') || CAST(n_chars % 30 + 1 AS VARCHAR) || '-' || CAST(doc_id % 40 + 1 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '-' || CAST(n_chars % 9 + 1 AS VARCHAR) ELSE '' END AS street, CASE WHEN n_chars % 3 = 0 THEN source || 'ビル' ELSE '' END AS building, true AS complete FROM documents""")
def t10_parts_of_rows(t: Tables):
    """Addresses with numbers from the rows, with and without a postal code, a third number and a building."""
    k, n = F.col("doc_id"), F.col("n_chars")
    lot = F.concat((n % 30 + 1).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("丁目"), (k % 40 + 1).cast("string"), F.lit("番"), (n % 9 + 1).cast("string"), F.lit("号"))).otherwise(F.concat(F.lit("－"), (k % 40 + 1).cast("string"))))
    address = F.concat(F.when(k % 3 == 0, "〒530-0001 ").otherwise(""), F.lit("大阪府大阪市"), F.coalesce("lang", F.lit("x")), lot, F.when(n % 3 == 0, F.concat(F.lit(" "), "source", F.lit("ビル"))).otherwise(""))
    return t.base("documents").select("doc_id", T.address_parts(address).alias("p")).select("doc_id", "p.*")


@query("SELECT doc_id, coalesce(lang, 'x') || CASE n_chars % 3 WHEN 0 THEN '市' || source || '区' WHEN 1 THEN '郡' || source || '町' ELSE '村' END AS municipality FROM documents")
def t12_municipality_of_rows(t: Tables):
    """City with ward, county with town and village, whose names come from the rows, below a prefecture and before numbers."""
    n = F.col("n_chars")
    place = F.concat(F.coalesce("lang", F.lit("x")), F.when(n % 3 == 0, F.concat(F.lit("市"), "source", F.lit("区"))).when(n % 3 == 1, F.concat(F.lit("郡"), "source", F.lit("町"))).otherwise(F.lit("村")))
    address = F.concat(F.lit("日本、〒530-0001 大阪府"), place, (n % 90 + 1).cast("string"), F.lit("-2"))
    return t.base("documents").select("doc_id", T.municipality(address).alias("municipality"))


_KINDS = ["paper_only", "electronic_only", "both_ok"]
_PICK = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"


@query(f"""WITH c AS (SELECT doc_id, [{{'area': CASE WHEN doc_id % 2 = 0 THEN 'seats' ELSE 'outside' END, 'type': {_PICK}[n_chars % 3 + 1]}}, {{'area': CASE WHEN n_chars % 2 = 0 THEN 'seats' ELSE 'outside' END, 'type': {_PICK}[doc_id % 3 + 1]}}, {{'area': 'seats', 'type': {_PICK}[(n_chars + doc_id) % 2 + 1]}}] AS c FROM documents),
e AS (SELECT doc_id, unnest(c).area AS area, unnest(c).type AS type, generate_subscripts(c, 1) AS k FROM c),
m AS (SELECT doc_id, area, min(k) AS k, CASE WHEN bool_or(type = 'both_ok') OR count(DISTINCT type) > 1 THEN 'both_ok' ELSE min(type) END AS type FROM e GROUP BY 1, 2) SELECT doc_id, list(area || ' ' || type ORDER BY k) AS conditions FROM m GROUP BY 1""")
def a21_types_of_rows(t: Tables):
    """Three conditions of each row, with areas and types that its numbers choose, merged by area."""
    k, n = F.col("doc_id"), F.col("n_chars")
    area = lambda when: F.when(when, "seats").otherwise("outside")
    kind = lambda i: F.get(F.array(*[F.lit(x) for x in _KINDS]), i.cast("int"))
    one = lambda a, b: F.struct(a.alias("area"), b.alias("type"))
    rows = F.array(one(area(k % 2 == 0), kind(n % 3)), one(area(n % 2 == 0), kind(k % 3)), one(F.lit("seats"), kind((n + k) % 2)))
    return t.base("documents").select("doc_id", F.transform(X.merged_types(rows), lambda c: F.concat_ws(" ", c["area"], c["type"])).alias("conditions"))


#: Clauses that the flat rules tell apart, each among the letters of a text.
_CLAUSES = ["分煙（加熱式たばこのみ可）", "テラス席での喫煙可", "2階は喫煙可能", "時間帯禁煙（11:00～14:00）", "昼2時まで禁煙", "喫煙不可 21時以降は喫煙可", "店外に灰皿あり", "入口横のベンチで喫煙", "喫煙専用室あり", "昼は禁煙、夜は喫煙可", "分煙 禁煙席あり", "全面喫煙可", "分煙", "全席喫煙可", "全席禁煙", "紙巻きたばこのみ喫煙可", "紙たばこは禁止、加熱式は喫煙可", "電子タバコのみ", "紙と加熱式の席", "紙タバコ", "none"]


def _ladder_sql(rules, default: str) -> str:
    hit = lambda where, patterns: " AND ".join(f"regexp_matches({where}_, '{X.half_width_pattern(p)}')" for p in patterns)
    return "CASE " + " ".join(f"WHEN {hit(where, patterns)} THEN '{label}'" for label, where, patterns in rules) + f" ELSE {default} END"


@query(f"""WITH f AS (SELECT doc_id, translate({_LETTERS} || chr(10) || [{', '.join(f"'{c}'" for c in _CLAUSES)}][n_chars % {len(_CLAUSES)} + 1], '（）～：', '()~:') AS field_, {_LETTERS} || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '喫煙所' ELSE '' END AS more FROM documents), g AS (SELECT *, field_ || chr(10) || more AS page_ FROM f)
SELECT doc_id, {_ladder_sql(X.AREA_RULES, 'NULL')} AS area, {_ladder_sql(X.TYPE_RULES, chr(39) + 'unknown' + chr(39))} AS type FROM g""")
def x08_classes_of_texts(t: Tables):
    """Flat classes by the whole ladders, of a clause among the letters of a text and a page that says more in every fourth row."""
    clause = F.get(F.array(*[F.lit(c) for c in _CLAUSES]), (F.col("n_chars") % len(_CLAUSES)).cast("int"))
    field = F.concat(_letters(), F.lit("\n"), clause)
    page = F.concat(_letters(), F.lit("\n"), F.when(F.col("doc_id") % 4 == 0, "喫煙所").otherwise(""))
    return t.base("documents").select("doc_id", X.smoking_area(field, page).alias("area"), X.smoking_type(field, page).alias("type"))
