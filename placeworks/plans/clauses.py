"""Hours and conditions from clauses about smoking (X05-X07): texts are put together from the lines of documents and from clauses whose times come from
their rows, in an order that the row decides; SQL works the answers out with the same times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeworks.operators import pasted
from placeworks.plans.registry import query
from placeworks.plans.roles import Tables

_KINDS = 15
#: Opening and closing of the two services, a midday cut, and an evening hour, in minutes, from columns id and n.
_TIMES = "600 + n % 4 * 30 AS a1, 840 + n // 4 % 3 * 30 AS b1, 1020 + n // 12 % 3 * 30 AS a2, 1320 + n // 36 % 7 * 30 AS b2, 690 + id % 5 * 30 AS c, 1110 + id % 4 * 30 AS d"


def _f(minute: str) -> str:
    return f"printf('%02d:%02d', ({minute}) // 60 % 24, ({minute}) % 60)"


def _r(a: str, b: str) -> str:
    return f"{_f(a)} || ' - ' || {_f(b)}"


#: By kind of clause: the hours of a weekday with two services, and of a weekend day with one; NULL where the text does not tell.
_WANTED = [
    (_r("greatest(a1, c)", "b2"), _r("greatest(a1, c)", "b2")),
    (
        f"CASE WHEN c > a1 THEN {_r('a1', 'c')} || CASE WHEN c + 60 < b1 THEN ', ' || {_r('c + 60', 'b1')} ELSE '' END || ', ' || {_r('a2', 'b2')} ELSE {_r('CASE WHEN c + 60 < b1 THEN c + 60 ELSE a2 END', 'b2')} END",
        f"CASE WHEN c > a1 THEN {_r('a1', 'c')} || ', ' ELSE '' END || {_r('c + 60', 'b2')}",
    ),
    (_r("d", "b2"), _r("d", "b2")),
    (f"{_r('a1', 'b1')} || ', ' || {_r('a2', 'b2')}", "'喫煙不可'"),
    (_r("a2", "b2"), "'喫煙不可'"),
    (_r("a2", "b2"), _r("b1", "b2")),
    (_r("a2", "b2"), "'喫煙不可'"),
    (_r("CASE WHEN c + 60 < b1 THEN c + 60 ELSE a2 END", "b2"), _r("a1", "b2")),
    None,
    (_r("720", "least(b2, 1440)"), _r("720", "b2")),  # a ban from midnight on holds on the next day for a service that begins after it
    (_r("a1", "b2"), _r("greatest(a1, c)", "b2")),
    ("NULL", "NULL"),
    (_r("a1", "b1"), _r("a1", "d")),
    (_r("a2", "b2"), "'喫煙不可'"),
    ("NULL", "NULL"),
]
_WANTED[8] = _WANTED[1]


def _sql(weekday: str, weekend: str) -> str:
    case = lambda k: "CASE kind " + " ".join(f"WHEN {i} THEN {w[k]}" for i, w in enumerate(_WANTED)) + " END"
    return f"""WITH rows_ AS (SELECT doc_id AS id, n_chars AS n, CAST(doc_id % {_KINDS} AS INTEGER) AS kind FROM documents), times AS (SELECT id, kind, {_TIMES} FROM rows_),
    told AS (SELECT id, kind, {case(0)} AS monday, {case(1)} AS saturday FROM times) SELECT id, kind, {weekday} AS monday, {weekend} AS saturday FROM told"""


def _clock(minute: Column, wrap: bool = True) -> Column:
    hour = F.floor(minute / 60)
    return F.format_string("%02d:%02d", F.pmod(hour, F.lit(24)) if wrap else hour, F.pmod(minute, F.lit(60)))


def _noise(nth: int) -> Column:
    """Letters of a line of the document, which say nothing about smoking."""
    line = F.get(F.split("text", "\n"), F.pmod(F.col("id") + nth, F.greatest(F.size(F.split("text", "\n")), F.lit(1))).cast("int"))
    return F.regexp_replace(F.coalesce(line, F.lit("")), r"[^\p{L} ]", "")


def _shops(t: Tables):
    """Rows with a field of hours and one about smoking."""
    rows = t.base("documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"), "text", (F.col("doc_id") % _KINDS).cast("int").alias("kind"))
    n, k = F.col("n"), F.col("id")
    part = lambda by, of: F.pmod(F.floor(n / by), F.lit(of)) * 30
    a1, b1, a2, b2, c, d = 600 + part(1, 4), 840 + part(4, 3), 1020 + part(12, 3), 1320 + part(36, 7), 690 + F.pmod(k, F.lit(5)) * 30, 1110 + F.pmod(k, F.lit(4)) * 30
    say = lambda text, **at: F.concat(*[_clock(at[x]) if x in at else F.lit(x) for x in text.split("|")])
    clauses = [
        say("|c|まで全席禁煙", c=c), say("|c|～|e|は禁煙", c=c, e=c + 60), say("|d|以降喫煙可", d=d), F.lit("土日祝は全面禁煙"), F.lit("昼は禁煙、夜は喫煙可"), F.lit("ランチタイムは禁煙"), F.lit("夜のみ喫煙可"),
        say("平日|c|～|e|は禁煙（土・日・祝　喫煙可）", c=c, e=c + 60), say("|f|～|g|喫煙可、|c|～|e|禁煙", f=d, g=d + 120, c=c, e=c + 60), F.lit("午前中は喫煙不可"), say("土、日、祝日は|c|まで禁煙", c=c), F.lit("全席喫煙可"),
        say("|d|まで喫煙可", d=d), F.lit("朝食時は禁煙、それ以外は喫煙可"), F.lit("ランチタイムは禁煙タイムあります"),
    ]
    clause = F.element_at(F.array(*clauses), F.col("kind") + 1)
    first = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    smoking = F.concat(F.when(F.pmod(F.col("n"), F.lit(3)) == 0, "").otherwise(F.concat(_noise(0), F.lit("\n"))), F.lit("分煙\n"), _noise(1), F.lit("\n"), clause, F.lit("\n"), _noise(2))
    weekdays = F.concat(F.lit("月・火・水・木・金\n"), _clock(a1), F.lit(" - "), _clock(b1), F.lit("\nL.O. 13:30\n"), _clock(a2), F.lit(" - "), _clock(b2))
    weekend = F.concat(F.lit("土・日・祝日\n"), _clock(a1), F.lit("～"), _clock(b2))
    hours = F.when(first, F.concat(weekdays, F.lit("\n"), weekend)).otherwise(F.concat(weekend, F.lit("\n"), weekdays))
    return rows.select("id", "kind", smoking.alias("smoking"), hours.alias("hours"))


@query(_sql("monday", "saturday"))
def x06_windows_of_clauses(t: Tables):
    """Smoking hours of a weekday and of a Saturday as text, by fifteen kinds of clauses among other lines."""
    told = _shops(t).select("id", "kind", pasted.smoking(F.col("smoking"), F.col("hours"))["hours_text"].alias("text"))
    of = lambda day: F.nullif(F.regexp_extract("text", rf"(?m)^{day} (.*)$", 1), F.lit(""))
    return told.select("id", "kind", of("月").alias("monday"), of("土").alias("saturday"))


_BARE = "nullif(replace({0}, ' - ', '-'), '喫煙不可')"


@query(_sql(_BARE.format("monday"), _BARE.format("saturday")))
def x05_windows_by_day(t: Tables):
    """The same hours as map by day; a day without smoking is not in it."""
    told = _shops(t).select("id", "kind", pasted.smoking(F.col("smoking"), F.col("hours"))["hours_by_day"].alias("days"))
    return told.select("id", "kind", F.try_element_at("days", F.lit("monday")).alias("monday"), F.try_element_at("days", F.lit("saturday")).alias("saturday"))


_SEATS = [("全席喫煙可", "both_ok"), ("カウンター席のみ喫煙可", "both_ok"), ("加熱式タバコのみ全席喫煙可", "electronic_only"), ("2階席は喫煙可", "both_ok"), ("紙タバコのみ喫煙可", "paper_only"), ("個室のみ喫煙可能", "both_ok"), ("全席禁煙", None)]
_PLACES = ["店外に喫煙所あり", "入口に灰皿あり", "店内に喫煙専用室あり", "屋外で喫煙可", None]


@query(f"""WITH rows_ AS (SELECT doc_id AS id, [{', '.join(f"'{k}'" if k else 'NULL' for _, k in _SEATS)}][n_chars % {len(_SEATS)} + 1] AS seats, doc_id % {len(_PLACES)} < {len(_PLACES) - 1} AS place, doc_id // {len(_PLACES)} % 2 = 0 AS seats_first FROM documents)
SELECT id, CASE WHEN seats IS NULL AND NOT place THEN ['unknown unknown'] WHEN seats IS NULL THEN ['separated both_ok'] WHEN NOT place THEN ['all_smoking ' || seats]
WHEN seats_first THEN ['all_smoking ' || seats, 'separated both_ok'] ELSE ['separated both_ok', 'all_smoking ' || seats] END AS conditions FROM rows_""")
def x07_conditions_of_clauses(t: Tables):
    """Conditions from a clause about seats and one about a place, in either order and with other lines between them."""
    rows = t.base("documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"), "text")
    pick = lambda k, values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values) + 1).cast("int"))
    seats, place = pick(F.col("n"), [s for s, _ in _SEATS]), F.coalesce(pick(F.col("id"), _PLACES), F.lit(""))
    first = F.pmod(F.floor(F.col("id") / len(_PLACES)), F.lit(2)) == 0
    lines = lambda a, b: F.concat_ws("\n", _noise(0), a, _noise(1), b, _noise(2))
    told = rows.select("id", F.when(first, lines(seats, place)).otherwise(lines(place, seats)).alias("raw"))
    found = pasted.smoking(F.col("raw"), F.lit(None).cast("string"))["conditions"]
    return told.select("id", F.transform(found, lambda c: F.concat_ws(" ", c["area"], c["type"])).alias("conditions"))
