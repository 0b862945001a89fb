"""Connected components of a graph of keys, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeworks.llm.store import written


def _state(edges: DataFrame) -> tuple:
    """Two numbers that tell whether the edges changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(key, label): each key of the edges (u, v) with the smallest key it is connected to.

    Every round hangs each key's larger neighbours on its smallest one, then its smaller neighbours and itself; edges never
    become more, and in a logarithmic number of rounds all that is left is stars. Rounds are written to the
    shared folder; only a count and a checksum reach the driver.
    """
    now = written(edges.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").filter("u != m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        now = written(small.unionByName(lowest.select(F.col("m").alias("u"), "v")).distinct())
        before, state = state, _state(now)
        if before == state:
            break
    return now.groupBy("v").agg(F.min("u").alias("label")).select(F.col("v").alias("key"), "label").unionByName(now.select(F.col("u").alias("key"), F.col("u").alias("label")).distinct())
