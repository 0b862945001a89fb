"""Supply at every level of its keys in one aggregate, and the level that a demand asks for (C14, Q21)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "*"


def _level(keys: list[str]) -> Column:
    """The keys as one text; a missing one stands for any value."""
    return F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit(ANY)) for k in keys]))


def cube_of(rows: DataFrame, keys: list[str], **measures: Column) -> DataFrame:
    """Measures for each combination of keys and of any value of them: one pass, 2^len(keys) rows at most for each distinct combination. A row without a
    key counts for any value only."""
    whole = rows.cube(*keys).agg(F.grouping_id().alias("_id"), *[m.alias(n) for n, m in measures.items()])
    bit = {k: 1 << (len(keys) - 1 - j) for j, k in enumerate(keys)}
    rolled = lambda k: F.col("_id").bitwiseAND(F.lit(bit[k])) != 0
    known = reduce(lambda a, b: a & b, [rolled(k) | F.col(k).isNotNull() for k in keys])
    return whole.filter(known).select(_level(keys).alias("level"), *measures)


def with_level(demand: DataFrame, cube: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """``demand`` with the measures of the level it names: a null key asks for any value; 0 where nothing is there. One equality join
    whatever the level, and as many rows of the cube for each key as there are: one."""
    joined = demand.withColumn("_level", _level(keys)).join(cube.withColumnRenamed("level", "_level"), "_level", "left")
    return joined.fillna(0, measures).drop("_level")
