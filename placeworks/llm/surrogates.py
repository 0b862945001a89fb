"""Personal data replaced by surrogates of the same kind, with DataFrame and SQL functions only.

1. Entities are found by one pattern, in one pass whose findings are written down; distinct ones are reduced to their units: an
   e-mail address in lower case and its domain, a number's digits, the words of a person's name. Mentions of one unit in other
   spellings share it, so coreference survives. A bare number of card length counts only if its checksum holds.
2. A unit's surrogate follows from a keyed hash: letters for letters, digits for digits, names of the same gender
   and script. Surrogates that two units share, or that equal a real unit, are drawn again with another
   attempt number, from a larger space each time once ``ATTEMPTS`` are spent, until all are distinct.
3. The surrogates are joined to the mentions and those, by the text's hash, to the documents, and the
   texts are put together from what lies between mentions and the surrogates. Bare surnames of persons
   found in a text are replaced too, where the words around them are those of a person.

Only texts with an entity are shuffled, once. Copies of a text share one map of replacements.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeworks.llm.store import written

ATTEMPTS, MOST_ATTEMPTS = 6, 40

#: Given names by gender, titles by gender, particles and syllables of surnames, beginnings of keys.
GIVEN = {
    ("f", "latin"): "Anna Maria Laura Julia Emma Sofia Clara Helena Elena Lucia Nora Alice Eva Irene Martha Olivia Paula Rosa Sara Teresa Victoria Diana Flora Greta Ingrid Astrid Karin Birgit Ursula Monika Petra Sabine Katrin Heike Isabel Carmen Pilar Beatriz Chiara Giulia Francesca Paola Camille Juliette Emily Hannah Rachel Rebecca Susan Linda Karen Nancy Elizabeth Jennifer Jessica Sarah Fatima Aisha",
    ("m", "latin"): "John Paul Martin Thomas Peter Daniel David Simon Oscar Hugo Victor Albert Anton Bruno Carl Edgar Felix George Henry Jacob Leo Max Robert Samuel Lars Sven Erik Magnus Klaus Dieter Wolfgang Stefan Andreas Matthias Carlos Miguel Javier Diego Pablo Luis Marco Luca Giovanni Alessandro Pierre Jacques Philippe Michael James William Richard Charles Joseph Christopher Anthony Steven Kevin Brian Mohammed Ahmed Omar",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Вера Нина Дарья Юлия Софья Тамара",
    ("m", "cyrillic"): "Иван Пётр Павел Сергей Андрей Олег Игорь Антон Борис Виктор Роман Фёдор",
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra Signora Госпожа", "m": "Mr Herr Monsieur Señor Sr Signor Господин", "n": "Dr Prof"}
PARTICLES = "von van der den de del della di da do dos du la le zu ter al bin"
#: Words before which a capitalised word is a thing's name, and words that follow the name of a person, besides those in -ed.
DETERMINERS = "the a an this that these those his her its my your our their some each every no der die das den dem des ein eine einen einem einer le la les un une el los las una il lo gli"
AFTER_PERSON = "is was are were has had have will would can could may might must shall should does did and or but who whom whose which with in on at to for from of by as than then not also never always still now said says told tells asked asks wrote writes left came comes went goes gave gives made makes took takes knew knows thought thinks saw sees met meets spoke speaks felt feels kept keeps lost loses won wins sent sends paid pays ran runs read reads got gets let began begins ist war hat hatte wird und oder aber mit kam ging sagte sagt schrieb est était a avait et ou mais dit avec es era ha había y o pero dijo con è aveva ma disse был была есть и или но с сказал сказала"
KEYS = "sk|pk|ghp|gho|ghs|xox[abp]|AKIA|AIza"
SYLLABLES = {
    "latin": "ba be bi bo bra bren da del do fa fer ga gol ha hel ka ker la lin lo ma mer mi mon na nel no pa per ra ren ri ro sa sel so ta ter to va vel win",
    "cyrillic": "ба бе бо ва ве ви га го да де до за ка ко ла ле ли ма ме ми на не но па пе ра ре ри ро са се со та те ти то фа ха ча ша",
}
ENDINGS = {"latin": "ton man ley berg son field wood ner", "cyrillic": "ов ев ин ский енко ук ич ник"}

_OUT = r"(?<![\p{L}\p{N}._%+-])"
_EDGE = r"(?![\p{L}\p{N}])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "(?:" + "|".join(t for group in TITLES.values() for t in group.split()) + r")\.?"
_MORE = rf"(?:(?: (?:{'|'.join(PARTICLES.split())}))*+ {_NAME})"
_GIVEN = "(?:" + "|".join(sorted({n for names in GIVEN.values() for n in names.split()})) + ")"
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)+",
    "secret": rf"(?:[0-9a-f]{{32,}}+|[0-9A-F]{{32,}}+|(?:{KEYS})[_-]?[A-Za-z0-9_-]{{16,}}+)" + _EDGE,
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _EDGE,
    "ip": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{N}]|\.\p{N})",
    "card": r"(?:[0-9]{4}[ -]?){3}[0-9]{1,7}" + _EDGE,
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _EDGE,
    "phone": r"(?:(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])|\([0-9]{2,4}\)[ .-]?|(?!(?:19|20)[0-9]{2} )[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){2,4}|0[1-9](?:[ .-][0-9]{2}){4})" + _EDGE,
    "person": rf"(?:{_TITLE}(?: (?:{'|'.join(PARTICLES.split())}))*+ {_NAME}{_MORE}*+|{_GIVEN}{_MORE}++)",
}
#: Around a bare surname: no determiner before it; after it an end, a mark, or a word that goes on about a person. So a surname that is a
#: word, too, stays where it is one: "the White House", "a White coat".
_NO_THING = rf"(?<![\p{{L}}\p{{N}}])(?<!(?<!\p{{L}})(?:{'|'.join(f'[{w[0].upper()}{w[0]}]{w[1:]}' for w in DETERMINERS.split())})\s)"
_PERSON_GOES_ON = rf"(?=$|['’]|[.,;:!?)\]\"»”](?!\p{{L}})|[\n\r]|\s(?:{'|'.join(AFTER_PERSON.split())}|\p{{Ll}}{{2,}}ed)(?!\p{{L}}))"
#: A plus sign or bracket may follow other signs; what a number may not follow is another letter or digit.
ENTITY = r"(?:" + _OUT + r"(?=[\p{L}\p{N}])(?:" + "|".join(PATTERNS.values()) + r")|(?<![\p{L}\p{N}])(?=[+(])" + PATTERNS["phone"] + ")"


def _kind(raw: Column) -> Column:
    kinds = [F.when(raw.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()]
    return F.coalesce(*kinds, F.lit("phone"))


def _words(options: str) -> Column:
    return F.array(*[F.lit(w) for w in options.split()])


def _draw(seed: Column, k, n) -> Column:
    """A number below n, at most 256, from the k-th byte of the seed's 64 (used again after that)."""
    return F.pmod(F.conv(F.substring(seed, F.pmod(k * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int"), n)


def _by_class(text: Column, seed: Column, keep: Column | int = 0) -> Column:
    """Characters of the same class: digits, small and capital letters; others, and the first ``keep``, stay."""
    letters = lambda first: lambda x, i: F.char(F.lit(first) + _draw(seed, i, F.lit(26)))

    def one(x: Column, i: Column) -> Column:
        return (
            F.when(i < keep, x)
            .when(x.rlike("[0-9]"), _draw(seed, i, F.lit(10)).cast("string"))
            .when(x.rlike(r"\p{Lu}"), letters(65)(x, i))
            .when(x.rlike(r"\p{L}"), letters(97)(x, i))
            .otherwise(x)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _hex(text: Column, seed: Column) -> Column:
    drawn = F.array_join(F.transform(F.split(text, ""), lambda x, i: F.lower(F.hex(_draw(seed, i, F.lit(16)).cast("long")))), "")
    return F.when(text == F.upper(text), F.upper(drawn)).otherwise(drawn)


def _luhn_sum(digits: Column) -> Column:
    """The checksum that is a multiple of ten for a valid number."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == 1
        return total + F.when(twice, F.floor(d * 2 / 10).cast("int") + F.pmod(d * 2, F.lit(10))).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)


def _card(unit: Column, longer: Column, seed: Column) -> Column:
    """Same first digit; a valid number gets a valid one."""
    drawn = _by_class(longer, seed, keep=1)
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(F.pmod(_luhn_sum(unit), F.lit(10)) == 0, F.concat(body, check)).otherwise(drawn)


def _name(kind: str, seed: Column, gender: Column, script: Column, attempt: int) -> Column:
    out = None
    for s in ("latin", "cyrillic"):
        syllables, endings = _words(SYLLABLES[s]), _words(ENDINGS[s])
        pick = lambda words, k: F.element_at(words, (_draw(seed, F.lit(k), F.size(words)) + 1).cast("int"))
        built = F.concat(*[pick(syllables, k) for k in range(2 + attempt // 2)])
        if kind == "surname":
            value = F.initcap(F.concat(built, pick(endings, 60)))
        else:
            # A person of unknown gender gets a name of either.
            female = (gender == "f") | ((gender == "n") & (_draw(seed, F.lit(61), F.lit(2)) == 0))
            invented = F.initcap(F.concat(built, F.when(female, F.lit("a" if s == "latin" else "а")).otherwise(F.lit("n" if s == "latin" else "н"))))
            listed = F.when(female, pick(_words(GIVEN["f", s]), 10)).otherwise(pick(_words(GIVEN["m", s]), 10))
            value = listed if attempt == 0 else invented
        out = F.when(script == s, value) if out is None else out.when(script == s, value)
    return out


def _surrogate(key: str, attempt: int) -> Column:
    """The surrogate of a unit at an attempt. Beyond ``ATTEMPTS`` it is longer by a character each time; an address takes any number
    of the address space after half of them."""
    kind, unit, gender, script = (F.col(c) for c in ("kind", "unit", "gender", "script"))
    seed = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), kind, unit, F.lit(f"{attempt}.{k}")), 256) for k in range(2)])
    octet = lambda k, first, n: (_draw(seed, F.lit(k), F.lit(n)) + first).cast("string")
    extra = max(0, attempt - ATTEMPTS + 1)
    longer = lambda text, with_: F.concat(text, F.lit(with_ * extra))
    digits = _by_class(longer(unit, "0"), seed)
    prefix = F.length(F.regexp_extract(unit, f"^(?:{KEYS})[_-]?", 0))
    return (
        F.when(kind == "email", _by_class(longer(F.substring_index(unit, "@", 1), "a"), seed))
        .when(kind == "domain", F.concat(_by_class(longer(F.substring_index(unit, ".", 1), "a"), seed), F.lit(".example."), F.element_at(_words("com net org"), (_draw(seed, F.lit(30), F.lit(3)) + 1).cast("int"))))
        .when(kind == "ip", F.concat_ws(".", F.lit("10") if 2 * attempt < ATTEMPTS else octet(3, 1, 223), octet(0, 0, 256), octet(1, 0, 256), octet(2, 1, 254)))
        .when(kind == "card", _card(unit, longer(unit, "0"), seed))
        .when((kind == "secret") & unit.rlike("^[0-9a-fA-F]+$"), F.when(unit == F.upper(unit), _hex(longer(unit, "A"), seed)).otherwise(_hex(longer(unit, "a"), seed)))
        .when(kind == "secret", _by_class(longer(unit, "a"), seed, keep=prefix))
        .when(kind == "iban", _by_class(longer(unit, "0"), seed, keep=2))
        .when(kind == "given", _name("given", seed, gender, script, attempt))
        .when(kind == "surname", _name("surname", seed, gender, script, attempt))
        .otherwise(digits)
    )


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _mentions(raws: DataFrame) -> DataFrame:
    """(raw, kind, place, unit_kind, unit, gender, script): the units of each distinct mention, with the place of each in it. A person's
    name has its words as units, but for the title and particles."""
    raw, kind = F.col("raw"), F.col("kind")
    title = F.regexp_extract(raw, f"^({_TITLE}) ", 1)
    names = F.split(F.regexp_replace(raw, f"^{_TITLE} ", ""), " ")
    bare = F.regexp_replace(title, r"\.", "")
    among = lambda c, words: c.isin(*words.split())
    listed = {g: " ".join(v for (x, _), v in GIVEN.items() if x == g) for g in "fm"}
    gender = F.when(among(bare, TITLES["f"]), "f").when(among(bare, TITLES["m"]), "m").when(among(names[0], listed["f"]), "f").when(among(names[0], listed["m"]), "m").otherwise("n")
    script = F.when(raw.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    digits = _digits(raw)
    unit = (
        F.when(kind == "phone", digits.substr(F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
        .otherwise(raw)
    )
    part = lambda name, place, value: F.struct(F.lit(name).alias("unit_kind"), F.lit(place).cast("int").alias("place"), value.alias("unit"))
    word = lambda w, i: F.struct(F.when(i == F.size(names) - 1, "surname").otherwise("given").alias("unit_kind"), i.cast("int").alias("place"), F.lower(w).alias("unit"))
    person = F.filter(F.transform(names, word), lambda p: ~among(p["unit"], PARTICLES) | (p["place"] == F.size(names) - 1))
    email = F.array(part("email", 0, F.lower(raw)), part("domain", 1, F.lower(F.substring_index(raw, "@", -1))))
    parts = F.when(kind == "person", person).when(kind == "email", email).otherwise(F.array(F.struct(kind.alias("unit_kind"), F.lit(0).alias("place"), unit.alias("unit"))))
    known = raws.withColumn("kind", _kind(raw)).filter(~((kind == "card") & raw.rlike("^[0-9]+$") & (F.pmod(_luhn_sum(raw), F.lit(10)) != 0)))
    rows = known.select("raw", "kind", gender.alias("gender"), script.alias("script"), F.explode(parts).alias("p"))
    return rows.select("raw", "kind", "gender", "script", F.col("p.place").alias("place"), F.col("p.unit_kind").alias("unit_kind"), F.col("p.unit").alias("unit")).filter("unit is not null")


def distinct_surrogates(units: DataFrame, key: str) -> DataFrame:
    """(kind, unit, surrogate) of distinct (kind, unit, gender, script): no two units of a kind share a
    surrogate and none is a real unit, upper and lower case being the same. Units that collide are drawn again, from a space that grows, so
    a few more rounds end it; if ``MOST_ATTEMPTS`` did not, an error says so."""
    # A unit is few bytes and much work: by their size alone all units would be drawn in one task.
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = written(units.repartition(n, "kind", "unit"))
    real = units.select("kind", F.lower("unit").alias("lowered"))
    folded = F.lower("surrogate").alias("lowered")
    waiting, done = units.repartition(n, "kind", "unit"), None
    for attempt in range(MOST_ATTEMPTS):
        drawn = waiting.withColumn("surrogate", _surrogate(key, attempt)).select("kind", "unit", "surrogate", folded)
        free = drawn.join(real, ["kind", "lowered"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", folded), ["kind", "lowered"], "left_anti")
        won = free.groupBy("kind", "lowered").agg(F.min(F.struct("unit", "surrogate")).alias("w")).select("kind", F.col("w.unit").alias("unit"), F.col("w.surrogate").alias("surrogate"))
        done = written(won if done is None else done.unionByName(won))
        waiting = units.join(done.select("kind", "unit"), ["kind", "unit"], "left_anti")
        if waiting.isEmpty():
            return done
    raise ValueError("no room for surrogates of the same format that differ")


def _filled(raw: Column, chars: Column, size: Column, kept: str) -> Column:
    """The mention with the last ``size`` of its characters of the class ``kept`` replaced by the first of ``chars``; all else (spaces, signs, a country
    code) stays, and what ``chars`` has more goes to the end."""
    count = lambda text: F.length(F.regexp_replace(text, f"[^{kept}]", ""))
    ahead = count(raw) - size
    nth = lambda i: count(F.substring(raw, F.lit(1), i + 1)) - ahead
    filled = F.transform(F.split(raw, ""), lambda x, i: F.when(x.rlike(f"[{kept}]") & (nth(i) > 0), F.substring(chars, nth(i), F.lit(1))).otherwise(x))
    return F.concat(F.array_join(filled, ""), F.substring(chars, size + 1, F.length(chars)))


def replacements(raws: DataFrame, key: str) -> DataFrame:
    """(raw, kind, replacement, surname) of distinct mentions; ``surname`` has a person's last name and its surrogate."""
    mentions = written(_mentions(raws))
    units = mentions.groupBy(F.col("unit_kind").alias("kind"), "unit").agg(F.min("gender").alias("gender"), F.min("script").alias("script"))
    made = distinct_surrogates(units, key)
    joined = mentions.join(made.withColumnRenamed("kind", "unit_kind"), ["unit_kind", "unit"])
    # the units of one mention, as many as its words at most
    rows = joined.groupBy("raw", "kind").agg(F.map_from_entries(F.collect_list(F.struct("place", "surrogate"))).alias("new"))
    raw, kind = F.col("raw"), F.col("kind")
    first = F.element_at("new", F.lit(0))
    title = F.regexp_extract(raw, f"^({_TITLE} )", 1)
    names = F.split(F.regexp_replace(raw, f"^{_TITLE} ", ""), " ")
    cased = lambda word, new: F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(new)).otherwise(new)
    words = F.transform(names, lambda w, i: F.coalesce(cased(w, F.element_at("new", i.cast("int"))), w))
    digits = F.length(_digits(raw))
    value = (
        F.when(kind == "person", F.concat(title, F.array_join(words, " ")))
        .when(kind == "phone", _filled(raw, first, F.least(digits, F.lit(10)), "0-9"))
        .when(kind.isin("card", "ssn"), _filled(raw, first, digits, "0-9"))
        .when(kind == "iban", _filled(raw, first, F.length(F.replace(raw, F.lit(" "), F.lit(""))), "0-9A-Z"))
        .when(kind == "email", cased(raw, F.concat(first, F.lit("@"), F.element_at("new", F.lit(1)))))
        .otherwise(first)
    )
    surname = F.when((kind == "person") & (F.length(F.element_at(names, -1)) > 2), F.struct(F.element_at(names, -1).alias("old"), F.element_at(words, -1).alias("new")))
    return rows.select("raw", "kind", value.alias("replacement"), surname.alias("surname"))


def _fresh(name: str, columns: list[str]) -> str:
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None, chars_col: str | None = None) -> DataFrame:
    """``docs`` with the entities in ``text_col`` replaced; all other columns stay as they are.

    ``found_col`` names a column to add: the kinds and mentions found, as map of replacements by mention. ``chars_col`` names one to
    set to the new number of characters. Null and empty texts stay. Rows are matched by their text, so null or repeated
    ids and repeated rows do no harm. An empty table stays empty. Columns of any names may be there.
    """
    text, columns = F.col(text_col), docs.columns
    hashed, table, mentions, surnames = (_fresh(name, columns) for name in ("text_hash", "replacements", "mentions", "surnames"))
    marked = written(docs.withColumn(mentions, F.coalesce(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.array().cast("array<string>"))))
    hits = marked.filter(F.size(mentions) > 0).withColumn(hashed, F.xxhash64(text))
    seen = written(hits.select(F.col(hashed).alias("hashed"), F.explode(mentions).alias("raw")).distinct())
    made = written(replacements(seen.select("raw").distinct(), key))
    maps = seen.join(made, "raw").groupBy(F.col("hashed").alias(hashed)).agg(F.map_from_entries(F.collect_set(F.struct("raw", "replacement"))).alias(table), F.collect_set("surname").alias(surnames))
    rows = hits.join(written(maps), hashed, "left")
    alone = lambda name: F.concat(F.lit(_NO_THING), name, F.lit(_PERSON_GOES_ON))
    between = F.transform(F.split(text, ENTITY, -1), lambda piece: F.aggregate(surnames, piece, lambda x, s: F.regexp_replace(x, alone(s["old"]), s["new"])))
    mapped = F.transform(mentions, lambda m: F.coalesce(F.element_at(F.col(table), m), m))
    rewritten = F.array_join(F.zip_with(between, mapped, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")
    out = rows.withColumn(text_col, F.when(F.col(table).isNull(), text).otherwise(rewritten))
    if chars_col and chars_col in columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    kept = [F.col(f"`{c}`") for c in columns]
    found = lambda value: [value.cast("map<string,string>").alias(found_col)] if found_col else []
    return out.select(*kept, *found(F.col(table))).unionByName(marked.filter(F.size(mentions) == 0).select(*kept, *found(F.lit(None))))
