"""Joins by role (J01-J17). Small sides are left to Spark's size check, never forced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeworks.functions.geo import METRES_PER_DEGREE, haversine_m

MAX_RULES = 10_000


def with_counts(left: DataFrame, events: DataFrame, key: str, name: str, agg: Column | None = None) -> DataFrame:
    """Left join to events aggregated first, so one row a key is joined and no row is doubled; none counts 0."""
    counts = events.groupBy(key).agg((F.count("*") if agg is None else agg).alias(name))
    return left.join(counts, key, "left").fillna(0, [name])


def pairs_of_groups(rows: DataFrame, keys: list[str], id_col: str = "id", chunk: int = 1000) -> DataFrame:
    """Pairs of rows that agree in ``keys``, the smaller id first, as a and b (structs of the rows). All pairs are the result; what a hot value would bring
    into one task is split: its rows are dealt into chunks of about ``chunk`` by the hash of their id, and each pair of chunks is a key of its own."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_chunks"))
    dealt = rows.join(sizes, keys).withColumn("_own", F.pmod(F.xxhash64(id_col), F.col("_chunks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda k: F.struct(F.least("_own", k).alias("x"), F.greatest("_own", k).alias("y")))
    side = lambda name: dealt.select(*keys, "_own", F.explode(others).alias("_met"), F.struct(*rows.columns).alias(name))
    a, b = side("a"), side("b").withColumnRenamed("_own", "_other")
    met = a.join(b, [*keys, "_met"]).filter(F.col(f"a.{id_col}") < F.col(f"b.{id_col}"))
    # rows of one chunk meet in the key of that chunk alone
    return met.filter((F.col("_own") != F.col("_other")) | (F.col("_met.x") == F.col("_met.y"))).select("a", "b")


def within_windows(instants: DataFrame, windows: DataFrame, minutes: int = 30, keys: tuple[str, ...] = ()) -> DataFrame:
    """Instants (weekday, minute) joined to the windows that hold them (J08): equality on the weekday and on slots of so many minutes, of which a window
    has each that it touches, with the range as residual; so there are as many keys as slots of the week, and a window meets only instants near it. ``keys`` must agree too, such as
    the shop whose windows they are; where those tell windows apart, slots may be whole days (``minutes`` of 1440). The windows' opening and closing come along.
    Spark sizes exploded rows as if there were none more, and would send them all to the driver to broadcast: both sides are shuffled."""
    slots = F.sequence(F.floor(F.col("opens") / minutes), F.floor((F.col("closes") - 1) / minutes))
    w = windows.filter("opens < closes").withColumn("_slot", F.explode(slots)).alias("w")
    i = instants.withColumn("_slot", F.floor(F.col("minute") / minutes)).alias("i")
    on = (F.col("i.weekday") == F.col("w.weekday")) & (F.col("i._slot") == F.col("w._slot")) & (F.col("w.opens") <= F.col("i.minute")) & (F.col("i.minute") < F.col("w.closes"))
    for key in keys:
        on = on & (F.col(f"i.{key}") == F.col(f"w.{key}"))
    found = i.join(w.hint("merge"), on)
    return found.select("i.*", *[f"w.{c}" for c in ("shop_id", "opens", "closes") if c not in keys]).drop("_slot")


def count_windows(instants: DataFrame, windows: DataFrame, name: str) -> DataFrame:
    """Instants (weekday, minute) with the number of windows that hold them (J08), without their pairs: openings and closings are
    summed by minute of the week, so the running sum and the join see at most one row for each of its minutes."""
    change = lambda c, n: F.struct(F.col(c).alias("minute"), F.lit(n).alias("change"))
    ends = windows.filter("opens < closes").select("weekday", F.explode(F.array(change("opens", 1), change("closes", -1))).alias("e"))
    changes = ends.groupBy("weekday", F.col("e.minute").alias("minute")).agg(F.sum("e.change").alias("change"))
    w = Window.partitionBy("weekday").orderBy("minute")
    steps = changes.select("weekday", "minute", F.sum("change").over(w).alias(name), F.lead("minute").over(w).alias("_next")).filter("_next is not null")
    minutes = steps.select("weekday", F.explode(F.sequence("minute", F.col("_next") - 1)).alias("minute"), name)
    return instants.join(minutes, ["weekday", "minute"], "left").fillna(0, [name])


def within_radius(points: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Points around one origin, with their distance; a box that the scan can use goes first."""
    import math

    half = metres / METRES_PER_DEGREE
    wide = half / max(math.cos(math.radians(lat)), 1e-9)
    box = points.filter(F.col("lat").between(lat - half, lat + half) & F.col("lon").between(lon - wide, lon + wide))
    return box.withColumn("distance_m", haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).filter(F.col("distance_m") <= metres)


def pairs_within(left: DataFrame, right: DataFrame, metres: float, lat_limit: float = 60.0) -> DataFrame:
    """Pairs of points (id, lat, lon) at most so far apart, for any number of origins.

    Cells are as high as the radius, and as wide as it is at ``lat_limit`` degrees; the left side goes to its nine
    neighbouring cells, so an equality join finds every pair and the distance is checked only there.
    """
    import math

    high = metres / METRES_PER_DEGREE
    wide = high / math.cos(math.radians(lat_limit))
    cell = lambda c, size, shift=0: (F.floor(F.col(c) / size) + shift).cast("long")
    around = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)]))
    a = left.select(F.col("id").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), around.alias("d"))
    a = a.withColumn("cy", F.floor(F.col("lat_a") / high).cast("long") + F.col("d.y")).withColumn("cx", F.floor(F.col("lon_a") / wide).cast("long") + F.col("d.x")).drop("d")
    b = right.select(F.col("id").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), cell("lat", high).alias("cy"), cell("lon", wide).alias("cx"))
    distance = haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return a.join(b, ["cy", "cx"]).filter(F.col("a") != F.col("b")).withColumn("distance_m", distance).filter(F.col("distance_m") <= metres).select("a", "b", "distance_m")


def _substrings(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))


def contained_in(whole: DataFrame, parts: DataFrame, gram: int = 4) -> DataFrame:
    """(whole, part) of distinct strings ``text`` on either side of which the second lies in the first.

    A part is looked up by its rarest substring of ``gram`` characters, counted over all of ``whole``: an equality join with the containment as
    residual. Shorter parts are looked up by themselves among the substrings of their own length, so none is lost; empty ones match nothing.
    Spark sizes exploded rows as if there were none more, and would broadcast them: their joins are merges.
    """
    w = whole.select("text").filter("text != ''").distinct()
    p = parts.select("text").filter("text != ''").distinct()
    grams = w.select(F.col("text").alias("whole"), F.explode(_substrings(F.col("text"), gram)).alias("g"))
    counts = grams.groupBy("g").agg(F.count("*").alias("n"))
    long = p.filter(F.length("text") >= gram).select(F.col("text").alias("part"), F.explode(_substrings(F.col("text"), gram)).alias("g"))
    # A gram that no whole has rules the part out, and is its rarest: the count is 0.
    rarest = long.hint("merge").join(counts, "g", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).filter("r.n > 0").select("part", F.col("r.g").alias("g"))
    found = grams.hint("merge").join(rarest, "g").filter(F.expr("contains(whole, part)")).select("whole", "part")
    short = p.filter(F.length("text") < gram).withColumnRenamed("text", "part")
    pieces = None
    for n in range(1, gram):
        own = w.filter(F.length("text") >= n).select(F.col("text").alias("whole"), F.explode(_substrings(F.col("text"), n)).alias("part"))
        pieces = own if pieces is None else pieces.unionByName(own)
    return found.unionByName(pieces.hint("merge").join(short, "part").select("whole", "part")) if pieces is not None else found


def names_in_queries(queries: DataFrame, names: DataFrame, least: int = 2, gram: int = 4) -> DataFrame:
    """Queries whose text without spaces contains a name of ``least`` characters or more."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[\s　]+", "")
    texts = queries.withColumn("_text", plain("query"))
    known = names.select(plain("name").alias("text")).filter(F.length("text") >= least)
    hits = contained_in(texts.select(F.col("_text").alias("text")), known, gram).select(F.col("whole").alias("_text")).distinct()
    return texts.join(hits, "_text", "left_semi").select(*queries.columns).distinct()


def containing_addresses(left: DataFrame, right: DataFrame, gram: int = 4) -> DataFrame:
    """Pairs (a, b) of ids whose normalised addresses contain one another (J11); ids of equal addresses meet by equality alone. Strings made
    from a narrow compressed column are larger than Spark takes them for, so neither side is broadcast."""
    a, b = left.select(F.col("id").alias("a"), F.col("address").alias("whole")), right.select(F.col("id").alias("b"), F.col("address").alias("part"))
    texts = lambda df: df.select(F.col("address").alias("text"))
    inside = contained_in(texts(left), texts(right), gram)
    around = contained_in(texts(right), texts(left), gram).filter("whole != part").select(F.col("whole").alias("part"), F.col("part").alias("whole"))
    return a.hint("merge").join(inside.unionByName(around), "whole").join(b.hint("merge"), "part").filter("a != b").select("a", "b").distinct()


def first_rule_join(rows: DataFrame, text: str, rules: DataFrame, key: str) -> DataFrame:
    """Label of the first rule (rule_order, label, keyword) whose keyword a row's text contains.

    Containment has no key to join on, so the rules go to every task; a table of more than ``MAX_RULES`` is refused.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rules = F.broadcast(rules)
    hit = F.lower(F.col(text)).contains(F.col("keyword"))
    found = rows.select(key, text).join(rules, hit).groupBy(key).agg(F.min_by("label", "rule_order").alias("label"))
    return rows.join(found, key, "left")


def best_match(pairs: DataFrame, key: str, score: str, other: str) -> DataFrame:
    """The other side of the highest score for each key, by its smallest id on ties."""
    return pairs.groupBy(key).agg(F.max_by(F.struct(other, score), F.struct(F.col(score), -F.col(other))).alias("m")).select(key, f"m.{other}", f"m.{score}")


def variant_similarity(a: Column, b: Column, measure) -> Column:
    """Highest similarity over all pairs of two arrays of variants."""
    return F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: measure(x, y)))))


def duplicate_flags(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each row whether another shares the value of each column (J17): a count by value, joined back, for each column.
    Blank values are shared by nobody."""
    out = rows
    for c in columns:
        shared = rows.filter(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).groupBy(c).agg(F.count("*").alias("_n")).filter("_n > 1").select(c, F.lit(True).alias(f"same_{c}"))
        out = out.join(shared, c, "left").fillna(False, [f"same_{c}"])
    return out.select(*rows.columns, *[f"same_{c}" for c in columns])
