"""Row filters as transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeworks.functions.text import LIST_SEPARATORS, SPACES, list_items


def among(c: Column, values: list) -> Column:
    """IN, where a None among the values matches nulls."""
    known = [v for v in values if v is not None]
    hit = c.isin(*known) if known else F.lit(False)
    return hit | c.isNull() if None in values else hit


def none_of(c: Column, values: list) -> Column:
    """NOT IN; null rows drop out."""
    return c.isNotNull() & ~c.isin(*values)


def in_viewport(df: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """F03, with the argument checks of F28."""
    if not all(isinstance(x, (int, float)) and abs(x) < float("inf") for x in (south, north, west, east)):
        raise ValueError("viewport bounds must be finite numbers")
    if south >= north or west >= east:
        raise ValueError("a viewport needs south < north and west < east")
    return df.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def since(c: Column, as_of: Column, days: int) -> Column:
    """F04."""
    return c >= as_of - F.make_dt_interval(F.lit(days))


def same_day(c: Column, as_of: Column) -> Column:
    return F.to_date(c) == F.to_date(as_of)


def stale(day: Column, as_of: Column, months: int = 24) -> Column:
    """Never, or longer ago than so many months."""
    return day.isNull() | (day < F.add_months(as_of, -months))


def keyword(columns: list[Column], word: str) -> Column:
    """Whether any column contains the word, whatever the case."""
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(word.lower()) for c in columns])


def all_keywords(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Every word of the query in some column."""
    import unicodedata

    for word in unicodedata.normalize("NFKC", query).lower().split():
        df = df.filter(keyword([F.col(c) for c in columns], word))
    return df


def all_tokens(haystack: Column, query: Column) -> Column:
    """Every word of a query column in one text."""
    return F.forall(F.filter(F.split(F.lower(query), SPACES), lambda t: t != ""), lambda t: F.lower(haystack).contains(t))


def has_token(columns: list[Column], terms: list[str], separators: str = LIST_SEPARATORS) -> Column:
    """Whether a term is a whole item of one of the lists."""
    wanted = F.array(*[F.lit(t) for t in terms])
    return reduce(lambda a, b: a | b, [F.coalesce(F.arrays_overlap(list_items(c, separators), wanted), F.lit(False)) for c in columns])


def expand_terms(terms: list[str], aliases: dict[str, str], synonyms: dict[str, list[str]]) -> list[str]:
    """Aliases resolved, then synonyms added; order of first appearance."""
    out: list[str] = []
    for term in terms:
        name = aliases.get(term, term)
        out += [t for t in (name, *synonyms.get(name, [])) if t not in out]
    return out


def contains_term(columns: list[Column], terms: list[str]) -> Column:
    """any term in any of the columns."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit("")).contains(t) for c in columns for t in terms], F.lit(False))


def type_matches(wanted: int, advanced: bool, primary: Column, secondary: Column) -> Column:
    """the first type, with ``advanced`` also the second; 0 (both) also as the pair of 1 and 2."""
    hit = primary == wanted
    if advanced:
        hit = hit | (secondary == wanted)
        if wanted == 0:
            hit = hit | ((primary == 1) & (secondary == 2)) | ((primary == 2) & (secondary == 1))
    return F.coalesce(hit, F.lit(False))


def approved(df: DataFrame) -> DataFrame:
    """F18."""
    return df.filter(F.col("approved") & ~F.col("on_hold"))


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key (F19, W02). One row a key reaches the shuffle: ranks are cut in the tasks first."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_reason_in(shops: DataFrame, reports: DataFrame, status: str, reasons: list[str]) -> DataFrame:
    """Shops whose latest report of a status has one of the reasons: a top-1 aggregate and a semi join."""
    last = reports.filter(F.col("status") == status).groupBy("shop_id").agg(F.max_by("reason", F.struct("updated_at", "id")).alias("reason"))
    return shops.join(last.filter(F.col("reason").isin(*reasons)), "shop_id", "left_semi")


#: Parts of the agents of crawlers.
BOTS = ("bot", "crawl", "spider", "slurp", "bingpreview", "duckduckbot", "yandex", "googlebot", "baiduspider", "facebookexternalhit", "twitterbot", "embedly", "pinterest")


def is_bot(agent: Column) -> Column:
    """F24."""
    return F.lower(F.coalesce(agent, F.lit(""))).rlike("|".join(BOTS))


def invalid_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the messages of those they break."""
    message = F.concat_ws(" / ", *[F.when(broken, F.lit(text)) for text, broken in rules.items()])
    return df.withColumn("errors", message).filter("errors != ''")


def with_support(df: DataFrame, count: str, least: int, rate: str, below: float) -> DataFrame:
    """F26."""
    return df.filter((F.col(count) >= least) & (F.col(rate) < below))


def filled_json(c: Column) -> Column:
    """Whether a JSON text holds anything: not null, no empty object or array, no JSON null (F16)."""
    return F.coalesce(~F.trim(c.cast("string")).isin("", "{}", "[]", "null"), F.lit(False))
