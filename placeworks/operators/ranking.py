"""Orderings, top-k, pages and aggregates by rank (O01-O16, W01-W07, A08-A21). Every order ends with a unique key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def listing_order(sort: str) -> list[Column]:
    """The named orders of a listing (O01). Held-back rows come last, then confirmed ones by falling date go first;
    ``rating`` and ``recommended`` are the same."""
    c = F.col
    low, dated, day = c("low_priority").asc(), c("last_confirmed_on").isNotNull().desc(), c("last_confirmed_on").desc_nulls_last()
    rating, reviews, opened, created = c("avg_rating").desc(), c("review_count").desc(), c("open_now").desc(), c("created_on").desc_nulls_last()
    orders = {
        "rating": [rating, reviews, opened, created],
        "recommended": [rating, reviews, opened, created],
        "reviews_count": [reviews, rating, opened, created],
        "newest": [created, rating, reviews, opened],
    }
    return [low, dated, day, *orders[sort], c("shop_id").asc()]


NEARBY_ORDER = ("open_now desc", "dated desc", "created_on desc", "shop_id")
POPULAR_ORDER = ("distance_m", "clicks desc", "dated desc", "last_confirmed_on desc nulls last", "created_on desc", "shop_id")
POPULAR_ORDER_ANYWHERE = ("clicks desc", "dated desc", "last_confirmed_on desc nulls last", "created_on desc", "shop_id")


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """Order written as 'column', 'column desc' or 'column desc nulls last'."""
    made = []
    for o in order:
        name, _, rest = o.partition(" ")
        c = F.col(name)
        made.append(c.desc_nulls_last() if rest.startswith("desc") else c.asc_nulls_last())
    return df.orderBy(*made)


def top(df: DataFrame, n: int, *order: str) -> DataFrame:
    """One task keeps n rows, never all."""
    return ordered(df, *order).limit(n)


def top_by(df: DataFrame, key: str | list[str], n: int, order: list[Column]) -> DataFrame:
    """First n rows of each key (W03, W04, W07); Spark cuts ranks before the shuffle."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def page(df: DataFrame, order: list[Column], number: int, per: int, total: int | None = None, sizes: tuple[int, ...] = ()) -> DataFrame:
    """A page of an order (O08); one beyond the last is the first, and a size that is not offered the smallest."""
    per = per if not sizes or per in sizes else sizes[0]
    per = min(max(per, 1), 500)
    if total is not None and number > max(1, math.ceil(total / per)):
        number = 1
    return df.orderBy(*order).offset((max(number, 1) - 1) * per).limit(per)


def category_order(c: Column, categories: list[str]) -> Column:
    """Rank of a category in a list, unknown ones last."""
    out = F.lit(len(categories))
    for k, v in reversed(list(enumerate(categories))):
        out = F.when(c == v, k).otherwise(out)
    return out


def suggestions(df: DataFrame, name: str, query: str, n: int = 12) -> DataFrame:
    """Names that begin with the query, then those that contain it."""
    low = F.lower(F.col(name))
    return df.filter(low.contains(query.lower())).select(name).distinct().orderBy(F.when(low.startswith(query.lower()), 0).otherwise(1), name).limit(n)


def options(df: DataFrame, c: str, last: str) -> DataFrame:
    """Distinct values in order, a catch-all at the end."""
    return df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy((F.col(c) == last).asc(), c)


def share(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Percent of the total with one decimal (W06): the total is one row."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.join(F.broadcast(total)).withColumn(name, F.when(F.col("_total") > 0, F.floor(F.col(value) * 1000.0 / F.col("_total") + 0.5) / 10).otherwise(0.0)).drop("_total")


def count_kinds(events: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Counts of each kind as columns, 0 where there is none."""
    return events.groupBy(*keys).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def outcome(approved: Column, pending: Column) -> Column:
    """A17, over a group's rows."""
    return F.when(F.bool_or(approved), "approved_or_rejected").when(F.bool_or(pending), "pending_only").otherwise("none")


def union_ranked(branches: list[DataFrame], key: str) -> DataFrame:
    """Rows of all branches once, with the first branch each is in."""
    out = None
    for k, b in enumerate(branches):
        one = b.select(key).withColumn("branch", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min("branch").alias("branch"))


def related(shops: DataFrame, articles: DataFrame, n: int = 3) -> DataFrame:
    """(shop_id, article, score, rank): the ``n`` published articles nearest to each shop's area and genre.

    Articles have id, areas, genres and has_image. The score depends on a shop's area and genre alone, so articles are ranked for each such pair; only the
    best ``n`` of an area, of a genre and of both can be among them, and no shop meets all articles. Where nothing fits, the newest articles stand.
    """
    of_area = articles.select("id", "has_image", F.explode(F.array_distinct("areas")).alias("area"))
    of_genre = articles.select("id", "has_image", F.explode(F.array_distinct("genres")).alias("genre"))
    both = of_area.join(of_genre.select("id", "genre"), "id")
    best = lambda df, keys: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("has_image"), F.desc("id")))).filter(F.col("_n") <= n).drop("_n")
    pairs = shops.select("area", "genre").distinct()
    found = pairs.join(best(of_area, ["area"]).select("area", "id"), "area").select("area", "genre", "id")
    found = found.unionByName(pairs.join(best(of_genre, ["genre"]).select("genre", "id"), "genre").select("area", "genre", "id"))
    found = found.unionByName(pairs.join(best(both, ["area", "genre"]).select("area", "genre", "id"), ["area", "genre"]).select("area", "genre", "id")).distinct()
    scored = found.join(articles, "id").withColumn("score", F.when(F.array_contains("areas", F.col("area")), 10).otherwise(0) + F.when(F.array_contains("genres", F.col("genre")), 6).otherwise(0) + F.when(F.col("has_image"), 2).otherwise(0))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("area", "genre").orderBy(F.desc("score"), F.desc("id")))).filter(F.col("rank") <= n)
    newest = articles.orderBy(F.desc("id")).limit(n).select("id").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("id"))))  # n rows
    rest = shops.join(ranked.select("area", "genre").distinct(), ["area", "genre"], "left_anti").select("shop_id").join(F.broadcast(newest)).select("shop_id", F.col("id").alias("article"), F.lit(0).alias("score"), "rank")
    return shops.join(ranked, ["area", "genre"]).select("shop_id", F.col("id").alias("article"), "score", "rank").unionByName(rest)


def in_rank_order(rows: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    """Rows of ranked keys with their rank, in its order."""
    return ranked.select(key, "rank").join(rows, key).orderBy("rank")


def rarest_blocks(blocks: DataFrame, key: str, by: list[str], n: int, counted: DataFrame | None = None) -> DataFrame:
    """For each ``key`` its ``n`` rarest blocks ``by`` (W07), counted over ``counted`` or the blocks themselves; ties go by the block. Blocks that
    ``counted`` does not have are left out."""
    sizes = (blocks if counted is None else counted).groupBy(*by).agg(F.count("*").alias("block_rows"))
    return top_by(blocks.join(sizes, by), key, n, [F.asc("block_rows"), *[F.asc(c) for c in by]])
