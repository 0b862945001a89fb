"""Codes and classes of catalogue fields (C05, C06, C27, C28, C31-C33, C36). Rule tables are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeworks.functions.text import contains_any, first_rule, is_blank, linkage_name


def query_type(query: Column, brands: list[str], facilities: list[str], unnatural: Column, names_shop: Column, has_intent: Column, looks_like_shop: Column) -> Column:
    """The first that applies. ``names_shop`` comes from a join with the catalogue's names, made once for all queries."""
    return (
        F.when(contains_any(query, brands), "brand_check")
        .when(contains_any(query, facilities), "facility")
        .when(unnatural | (names_shop & ~has_intent) | looks_like_shop, "specific_shop")
        .otherwise("general")
    )


def looks_like_shop(query: Column, address: str, brands: list[str], topic: list[str], shop_words: list[str], suffix: str, most_words: int = 3) -> Column:
    """Addresses and brands are shops, the topic's words are not, shop words and suffixes are; else short queries are."""
    words = F.size(F.filter(F.split(F.trim(query), r"[\s　]+"), lambda w: w != ""))
    return F.when(query.rlike(address) | contains_any(query, brands), True).when(contains_any(query, topic), False).when(contains_any(query, shop_words) | query.rlike(suffix), True).otherwise(words <= most_words)


def area(station: Column, address: Column, rules: list[tuple[str, str]]) -> Column:
    """The station's rules first, then the address's."""
    return F.coalesce(first_rule(linkage_name(station), rules), first_rule(linkage_name(address), rules))


def genre(c: Column, prefixes: dict[str, str], aliases: dict[str, str], known: list[str], other: str) -> Column:
    """A known genre with what was written if it is not known."""
    named = reduce(lambda out, p: F.when(c.startswith(p[0]), p[1]).otherwise(out), reversed(list(prefixes.items())), F.lit(None).cast("string"))
    alias = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[c] if aliases else F.lit(None).cast("string")
    value = F.coalesce(named, alias, c)
    return F.struct(F.when(value.isin(*known), value).otherwise(other).alias("genre"), F.when(~value.isin(*known), c).alias("original"))


def may_be_approved(columns: list[Column], note: Column, unknown_marks: list[str]) -> Column:
    """All fields are there and the note has no mark of doubt."""
    filled = reduce(lambda a, b: a & b, [~is_blank(c) for c in columns])
    return filled & ~contains_any(note, unknown_marks)


def code(c: Column, values: dict[str, int]) -> Column:
    """Code of a text or of a number in text, null if unknown."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[F.lower(F.trim(c))]


def statement_class(c: Column, rules: list[tuple[str, str]]) -> Column:
    """C33."""
    return first_rule(c, rules, "other")


def restricted(note: Column, hours: Column, bans: str) -> Column:
    """The note bans a time of day while no hours say so."""
    return is_blank(hours) & F.coalesce(note.rlike(bans), F.lit(False))
