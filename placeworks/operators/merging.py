"""Overlays, upserts and snapshots of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeworks.functions.text import presence


def _empty(c: Column, kind: str) -> Column:
    if kind == "string":
        return c.isNull() | F.trim(c).isin("", "{}", "[]", "unknown")
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def fill_blank(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Blank fields of the target filled from the source's row of the same key."""
    kinds = dict(target.dtypes)
    s = source.select(key, *[F.col(c).alias(f"_s_{c}") for c in columns])
    joined = target.join(s, key, "left")
    return joined.select(*[F.when(_empty(F.col(c), kinds[c]), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in target.columns])


def overlay(target: DataFrame, proposed: DataFrame, key: str, columns: list[str], also_null: list[str] = ()) -> DataFrame:
    """Proposed values that are not blank win; those of ``also_null`` win even as nulls where a proposal exists."""
    p = proposed.select(key, F.lit(True).alias("_any"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = target.join(p, key, "left")
    kinds = dict(target.dtypes)
    value = lambda c: F.when(F.col("_any"), F.col(f"_p_{c}")).otherwise(F.col(c)) if c in also_null else F.coalesce(presence(F.col(f"_p_{c}")) if kinds[c] == "string" else F.col(f"_p_{c}"), F.col(c))
    return joined.select(*[value(c).alias(c) if c in columns else c for c in target.columns])


def snapshot(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def first_link(links: list[tuple[str, Column]]) -> Column:
    """URL and label of the first non-blank link."""
    url = F.coalesce(*[presence(c) for _, c in links])
    label = F.coalesce(*[F.when(presence(c).isNotNull(), F.lit(name)) for name, c in links])
    return F.struct(url.alias("url"), label.alias("label"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """New rows replace old ones of the same key; with ``update`` only those columns change."""
    if update is None:
        return old.join(new, keys, "left_anti").unionByName(new)
    fresh = new.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in update])
    kept = old.join(fresh, keys, "left").select(*[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in update else c for c in old.columns])
    return kept.unionByName(new.join(old, keys, "left_anti").select(*old.columns))


def rebuild(spark, df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def dictionary(df: DataFrame, value: str, key: str = "value_id") -> tuple[DataFrame, DataFrame]:
    """Distinct values by hash, and the rows with the hash instead."""
    hashed = df.withColumn(key, F.xxhash64(value))
    return hashed.select(key, value).distinct(), hashed.drop(value)
