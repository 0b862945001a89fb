"""String columns: normalisation, similarity, URLs, identifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACES = r"[\s　]+"
#: Separators of lists written into one string.
LIST_SEPARATORS = r"[、，,・/／|｜\n]"


def is_blank(c: Column) -> Column:
    """Null, empty, or white space of any script (T: blank)."""
    return c.isNull() | (F.regexp_replace(c, SPACES, "") == "")


def presence(c: Column) -> Column:
    """The value, or null if it is blank."""
    return F.when(~is_blank(c), c)


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it."""
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def squeeze(c: Column) -> Column:
    """Lower case, runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), SPACES, " "))


def strip_spaces(c: Column) -> Column:
    return F.regexp_replace(c, SPACES, "")


FULL_WIDTH = "".join(chr(k) for k in range(0xFF01, 0xFF5F)) + "　"
ASCII = "".join(chr(k) for k in range(0x21, 0x7F)) + " "


def half_width(c: Column) -> Column:
    """Full-width ASCII to ASCII."""
    return F.translate(c, FULL_WIDTH, ASCII)


PUNCTUATION = r"[-‐‑–—―−ー・･.,，．、。'’\"“”()（）\[\]【】「」]"


def without_punctuation(c: Column) -> Column:
    """T04."""
    return F.regexp_replace(c, PUNCTUATION, "")


def duplicate_key(c: Column) -> Column:
    """Half-width, lower case, no white space, no punctuation: equal for spellings of one name."""
    return without_punctuation(strip_spaces(F.lower(half_width(c))))


def linkage_name(c: Column) -> Column:
    """As T05 but punctuation and so branch names are kept; NFKC instead of a table."""
    return strip_spaces(F.lower(nfkc(c)))


def lookup_name(c: Column) -> Column:
    """Linkage name without middle dots, quotes, brackets and dashes."""
    return F.regexp_replace(linkage_name(c), r"[・･'’\"“”()（）\-‐–—ー]", "")


def core_name(c: Column, rules: list[str]) -> Column:
    """Remove what each pattern of ``rules`` matches, in order."""
    for rule in rules:
        c = F.regexp_replace(c, rule, "")
    return F.trim(c)


def digits(c: Column) -> Column:
    """The digits, null if there are none."""
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))


def without_postal_prefix(c: Column) -> Column:
    """A country name, a postal mark and code, in front of an address."""
    return F.regexp_replace(c, r"^\s*(?:日本[、,]?\s*)?(?:〒\s*)?(?:\d{3}-?\d{4})?\s*", "")


MUNICIPALITY = r"^(?:東京都|北海道|(?:大阪|京都)府|.{2,3}県)?((?:.+?市.+?区)|(?:.+?郡.+?[町村])|(?:.+?[市区町村]))"


def municipality(c: Column) -> Column:
    """City with ward, county with town, or town."""
    return F.nullif(F.regexp_extract(without_postal_prefix(c), MUNICIPALITY, 1), F.lit(""))


def kanji_number(c: Column) -> Column:
    """一 to 九十九 as an int, null otherwise."""
    value = lambda part: F.instr(F.lit("一二三四五六七八九"), part)
    tens = F.when(F.instr(c, "十") == 0, 0).when(F.substring_index(c, "十", 1) == "", 1).otherwise(value(F.substring_index(c, "十", 1)))
    ones = F.when(F.instr(c, "十") == 0, value(c)).when(F.substring_index(c, "十", -1) == "", 0).otherwise(value(F.substring_index(c, "十", -1)))
    return F.when(c.rlike("^(?:[一二三四五六七八九]?十[一二三四五六七八九]?|[一二三四五六七八九])$"), (tens * 10 + ones).cast("int"))


DASHES = "-‐‑‒–—―−ー"
_NUMBER = "(?:[0-9]+|[一二三四五六七八九十]+)"
_MARKER = f"(?:丁目|番地|番|号|[{DASHES}])"


def address_parts(c: Column) -> Column:
    """Street key (what is before the lot, its numbers joined by dashes), building, and whether there is a lot number.

    A lot begins at the first number with a marker (丁目, 番地, 番, 号 or a dash) behind it and goes on until a number without one, or 号. Without
    such a number all of the address is the street. ``complete`` also asks for a municipality. NFKC is the one Python step.
    """
    text = F.trim(F.lower(nfkc(c)))
    text = F.trim(F.regexp_replace(text, rf"^(?:日本[、,\s]*)?(?:〒\s*)?\d{{3}}[{DASHES}]?\d{{4}}\s*", ""))
    lot = rf"(?s)^(.*?)({_NUMBER}\s*{_MARKER}(?:(?<!号)\s*{_NUMBER}\s*{_MARKER})*(?:(?<!号)\s*{_NUMBER})?)(.*)$"
    before, middle, after = (F.regexp_extract(text, lot, k) for k in (1, 2, 3))
    number = lambda x: F.when(x.rlike("^[0-9]+$"), x).otherwise(F.coalesce(kanji_number(x).cast("string"), x))
    numbers = F.array_join(F.transform(F.regexp_extract_all(middle, F.lit(_NUMBER), F.lit(0)), number), "-")
    found = middle != ""
    blank = F.coalesce(is_blank(c), F.lit(True))
    street = F.when(found, F.concat(strip_spaces(before), numbers)).otherwise(strip_spaces(text))
    complete = found & (F.coalesce(municipality(text), F.lit("")) != "")
    return F.struct(F.when(~blank, street).alias("street"), F.when(~blank, F.when(found, strip_spaces(after)).otherwise("")).alias("building"), F.when(blank, False).otherwise(complete).alias("complete"))


def bigrams(c: Column, most: int = 80) -> Column:
    """Distinct two-character substrings of the first ``most`` characters, as the measure is defined; a single character has none."""
    s = F.substring(c, 1, most)
    n = F.length(s)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """2 |A & B| / (|A| + |B|) of two gram arrays; 0 if both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """1 for equal non-blank strings, 0 if one is blank, else the Dice coefficient of bigrams."""
    return F.when(is_blank(a) | is_blank(b), 0.0).when(a == b, 1.0).otherwise(dice(bigrams(a), bigrams(b)))


def common_suffix_length(a: Column, b: Column) -> Column:
    """Length of the longest common suffix."""
    ra, rb, n = F.reverse(a), F.reverse(b), F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(ra, i, F.lit(1)) == F.substring(rb, i, F.lit(1)))
    first = F.array_position(same, False)
    return F.when(n == 0, 0).when(first == 0, n).otherwise((first - 1).cast("int"))


def without_common_branch(a: Column, b: Column) -> Column:
    """``a`` without a common ending of four characters or more that ends as a branch or building name does."""
    k = common_suffix_length(a, b)
    return F.when((k >= 4) & a.rlike("(?:店|ビル)$"), F.substring(a, F.lit(1), F.length(a) - k)).otherwise(a)


def name_variants(c: Column) -> Column:
    """The name, and the name without a trailing Latin note in brackets."""
    return F.array_distinct(F.array(c, F.regexp_replace(c, r"[(（][A-Za-z0-9 .&'-]+[)）]$", "")))


def floors(c: Column) -> Column:
    """Floor numbers named in a text, basements with a b in front."""
    found = F.regexp_extract_all(F.lower(half_width(c)), F.lit(r"(?<![a-z0-9])(b?\d{1,2})(?:f|階)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def canonical_url(url: Column, hosts: list[str] | None = None, reserved: list[str] = ()) -> Column:
    """https URL of host and path: no user, port, query, fragment or trailing slash; null if the
    scheme is not http(s), the host not among ``hosts`` or the first path segment ``reserved`` (T19)."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    fit = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & host.isNotNull() & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    if hosts is not None:
        fit &= host.isin(*hosts)
    if reserved:
        fit &= ~F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit("")).isin(*reserved)
    return F.when(fit, F.concat(F.lit("https://"), host, path))


def into_template(template: str, c: Column) -> Column:
    """The percent-encoded value in place of {url}."""
    return F.replace(F.lit(template), F.lit("{url}"), F.url_encode(c))


def with_query_param(url: Column, name: str, value: Column) -> Column:
    """URL with one query parameter dropped if present and appended anew; the others keep their order."""
    base, query = F.substring_index(url, "?", 1), F.when(F.instr(url, "?") > 0, F.substring_index(url, "?", -1)).otherwise("")
    others = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith(f"{name}="))
    return F.concat(base, F.lit("?"), F.array_join(F.concat(others, F.array(F.concat(F.lit(f"{name}="), value))), "&"))


def shortcode_ids(body: Column, tag: str = "shop") -> Column:
    """Ids of [tag id=...] codes, in order."""
    return F.transform(F.regexp_extract_all(body, F.lit(rf"(?i)\[{tag}\s+id=[\"']?(\d+)[\"']?\s*\]"), F.lit(1)), lambda x: x.cast("long"))


def list_items(c: Column, separators: str = LIST_SEPARATORS) -> Column:
    """Trimmed, non-blank items of a list in one string."""
    return F.filter(F.transform(F.split(c, separators), lambda x: F.trim(F.regexp_replace(x, SPACES, " "))), lambda x: x != "")


def first_rule(c: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first (label, pattern) whose pattern the lower-cased text matches."""
    out = None
    for label, pattern in rules:
        hit = F.lower(c).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default).cast("string")) if out is not None else F.lit(default).cast("string")


def contains_any(c: Column, keywords: list[str]) -> Column:
    """Whether the lower-cased text contains any of the keywords."""
    if not keywords:
        return F.lit(False)
    low = F.lower(F.coalesce(c, F.lit("")))
    hits = [low.contains(k.lower()) for k in keywords]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def leading_number(c: Column) -> Column:
    """The number a text begins with, 0 without one."""
    return F.coalesce(F.regexp_extract(F.trim(c), r"^[-+]?[0-9]*\.?[0-9]+", 0).try_cast("double"), F.lit(0.0))


def percent(c: Column) -> Column:
    """'12%' and 12 as 12, 0.12 as 12."""
    n = leading_number(c)
    return F.when(c.contains("%"), n).when(n <= 1, n * 100).otherwise(n)


def slug(c: Column) -> Column:
    """T26."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def sql_fingerprint(c: Column) -> Column:
    """Hash of a statement without comments, literals and spacing."""
    for pattern, to in ((r"/\*.*?\*/", " "), (r"'(?:[^']|'')*'", "?"), (r"\b\d+(?:\.\d+)?\b", "?"), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, to)
    return F.substring(F.sha2(F.trim(c), 256), 1, 16)


def nearest_station(c: Column) -> Column:
    """Station of the least walking minutes, then metres, among 'name ... N分 / Mm' lines (T28). Other lines are left out first, so that long words
    in them are not searched from each of their characters."""
    c = F.array_join(F.filter(F.split(c, "\n"), lambda x: x.contains("駅")), "\n")
    names = F.regexp_extract_all(c, F.lit(r"([^\s、,。]+?駅)[^\n]*?(?:\d+\s*分|\d+\s*m)"), F.lit(1))
    lines = F.regexp_extract_all(c, F.lit(r"([^\s、,。]+?駅[^\n]*?(?:\d+\s*分|\d+\s*m))"), F.lit(1))
    unit = lambda line, u: F.coalesce(F.regexp_extract(line, rf"(\d+)\s*{u}", 1).try_cast("int"), F.lit(1 << 30))
    best = F.array_min(F.zip_with(lines, names, lambda line, name: F.struct(unit(line, "分"), unit(line, "m"), name.alias("name"))))
    return best["name"]


def route(c: Column) -> Column:
    """Path with numeric segments replaced by :id."""
    return F.regexp_replace(c, r"/\d+(?=/|$)", "/:id")


def phone(c: Column) -> Column:
    """First phone number in a text, null without one."""
    return F.nullif(F.regexp_extract(half_width(c), r"(?<!\d)(0\d{1,4}-\d{1,4}-\d{3,4}|0\d{9,10})(?!\d)", 1), F.lit(""))


def join_present(sep: str, *columns: Column) -> Column:
    """Non-blank values joined."""
    return F.concat_ws(sep, *[presence(c) for c in columns])


def difference(a: Column, b: Column) -> Column:
    """Common prefix, both middles, common suffix of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    at = F.array_position(same, False)
    head = F.when(n == 0, 0).when(at == 0, n).otherwise((at - 1).cast("int"))
    tail = F.least(common_suffix_length(a, b), n - head)
    middle = lambda s: F.substring(s, head + 1, F.length(s) - head - tail)
    return F.struct(F.substring(a, F.lit(1), head).alias("prefix"), middle(a).alias("left"), middle(b).alias("right"), F.substring(a, F.length(a) - tail + 1, tail).alias("suffix"))
