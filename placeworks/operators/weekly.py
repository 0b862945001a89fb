"""Weekly opening hours as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeworks.functions import hours as H
from placeworks.functions.arrays import DAYS
from placeworks.functions.times import minutes


def merged_windows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges (opens, closes) of each key, those that touch or overlap made one: a running maximum of the ends tells
    where a new range begins."""
    w = Window.partitionBy(*keys).orderBy("opens", "closes")
    before = F.max("closes").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.filter("opens < closes").withColumn("_new", F.when(before.isNull() | (F.col("opens") > before), 1).otherwise(0))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("opens").alias("opens"), F.max("closes").alias("closes")).drop("_island")


def exploded(df: DataFrame, opens: str = "open_min", closes: str = "close_min") -> DataFrame:
    """One row for each range that hours cover on their weekday."""
    return df.withColumn("_r", F.explode(H.segments(F.col(opens), F.col(closes)))).withColumn("opens", F.col("_r.start")).withColumn("closes", F.col("_r.end")).drop("_r")


def projection(shops: DataFrame) -> DataFrame:
    """(shop_id, weekday, opens, closes) of shops with a schedule map, hours text by weekday and holiday text.

    A holiday text that has ranges holds on every weekday; else the schedule does, without its breaks; else the text's lines.
    """
    day = F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.col("weekday") + 1)
    rows = shops.withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("_d", F.try_element_at(F.col("schedule"), day))
    of = lambda ranges: F.flatten(F.transform(ranges, lambda r: H.segments(r["start"], r["end"])))
    holiday = of(H.text_ranges(F.coalesce("holiday_text", F.lit("")), ""))
    d = F.col("_d")
    rests = F.coalesce(d["break_enabled"], F.lit(False))
    breaks = F.when(rests, H.segments(minutes(d["break_start"]), minutes(d["break_end"]))).otherwise(F.array().cast(H.RANGES))
    planned = F.when(F.coalesce(d["closed"], F.lit(False)), F.array().cast(H.RANGES)).otherwise(H.subtract(H.segments(minutes(d["open"]), minutes(d["close"])), breaks))
    label = F.element_at(F.array(*[F.lit(x) for x in "日月火水木金土"]), F.col("weekday") + 1)
    lines = F.filter(F.split(F.coalesce("hours_text", F.lit("")), r"[\n/]"), lambda x: F.contains(x, label))
    found = F.flatten(F.transform(lines, lambda x: H.text_ranges(x, "")))
    ranges = F.when(F.size(holiday) > 0, holiday).when(d.isNotNull(), planned).otherwise(of(found))
    merged = rows.select("shop_id", "weekday", F.explode(H.merge(ranges)).alias("r"))
    return merged.select("shop_id", "weekday", F.col("r.start").alias("opens"), F.col("r.end").alias("closes"))


def open_at(windows: DataFrame, weekday: int, minute: int) -> DataFrame:
    """Shops with a window that holds the minute (Q29)."""
    return windows.filter((F.col("weekday") == weekday) & (F.col("opens") <= minute) & (F.col("closes") > minute)).select("shop_id").distinct()


def per_schedule(shops: DataFrame, columns: list[str], value, name: str) -> DataFrame:
    """A costly function of a schedule computed once for each distinct one."""
    distinct = shops.select(*columns).distinct().withColumn(name, value)
    condition = None
    d = distinct.select(*[F.col(c).alias(f"_k_{c}") for c in columns], name)
    for c in columns:
        same = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        condition = same if condition is None else condition & same
    return shops.join(d, condition, "left").drop(*[f"_k_{c}" for c in columns])
