"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key, divided by its quality weight; within a source the documents of the smallest keys come first,
which is a weighted sample without replacement whatever its size (Efraimidis and Spirakis). A source's target in words is met
by whole epochs first, then by the documents in key order whose running sum of words fits the rest; the document on which the
rest ends gives its first words only, so each source meets its target to a word.

Running sums are made without a group of one source: rows are dealt by ranges of (source, key), summed within each partition, and
shifted by what the partitions before hold, of which one row each is known. Texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeworks.llm import textkit as tk
from placeworks.llm.quality import Ranking, features
from placeworks.llm.store import written

WEIGHTS, MOST_EPOCHS, LEAST_QUALITY = (5, 2, 1), 3, 1e-3


def running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``rows`` with a column ``before_<c>`` for each long column of ``sums``: its sum over all rows that come before in ``order``.

    Rows that are equal in ``order`` go to one partition, so it should end with a column that differs.
    """
    at = [rows.columns.index(c) for c in sums]
    names = [f"before_{c}" for c in sums]

    def summed(batches):
        so_far, part = np.zeros(len(at), np.int64), TaskContext.get().partitionId()
        for b in batches:
            values = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in at]
            ends = [np.cumsum(v) + s for v, s in zip(values, so_far)]
            if b.num_rows:
                so_far = np.array([e[-1] for e in ends], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(e - v) for e, v in zip(ends, values)], pa.array(np.full(b.num_rows, part, np.int32))], names=[*b.schema.names, *names, "part"])

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = written(dealt.mapInArrow(summed, _schema(rows, names)))
    totals = inside.groupBy("part").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = totals.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"shift_{c}") for c in sums])
    shifted = inside.join(F.broadcast(shifts), "part")
    return shifted.select(*rows.columns, *[(F.col(n) + F.col(f"shift_{c}")).alias(n) for c, n in zip(sums, names)])


def _schema(rows: DataFrame, names: list[str]) -> str:
    return ", ".join([*[f"`{c}` {kind}" for c, kind in rows.dtypes], *[f"`{n}` long" for n in names], "part int"])


def by_learned_quality(ranking: Ranking) -> Callable:
    """Quality weights of a slice of texts: the score of the pairwise ranking, to three digits so that they don't hang on the order of sums."""
    return lambda data, offsets: np.round(ranking.score(features(data, offsets)), 3)


def alike(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.ones(len(offsets) - 1)


def measured(docs: DataFrame, weigh: Callable = alike, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, draw, size, quality) of every row: its words between ASCII white space, the weight that ``weigh``
    gives its text, and the hash its key is drawn from."""

    def counted(batches):
        for b in batches:
            size, quality = [], []
            for _, _, data, offsets in tk.text_slices(b.column(3)):
                size.append(np.bincount(tk.space_words(data, offsets)[2], minlength=len(offsets) - 1))
                quality.append(weigh(data, offsets))
            flat = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], flat(size, np.int64), flat(quality, np.float64)], names=["doc_id", "source", "draw", "size", "quality"])

    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(id_.alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.lit("mix"), id_, text).alias("draw"), text.alias("text")).mapInArrow(counted, "doc_id long, source string, draw long, size long, quality double")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, place, source_size, weight, target) of each row (source, source_size).

    Sources in the order of their code points, null last, have ``weights`` in turn and share the sum of all sizes by them, but none more than
    ``most_epochs`` times its own size. A source is at that bound if its share at the final level would pass it, and the level is what
    the others then share: the first source in order of bound over weight that is below its bound tells it.
    """
    placed = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").isNull(), F.col("source")], ["one"])
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("before_one") % len(weights)).cast("int") + 1)
    placed = written(placed.select("source", F.col("before_one").alias("place"), "source_size", weight.alias("weight"), (F.col("source_size") * most_epochs).alias("bound")))
    words, shares = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    filling = running(placed, [F.col("bound") / F.col("weight"), F.col("place")], ["bound", "weight"])
    level = (F.lit(words) - F.col("before_bound")) / (F.lit(shares) - F.col("before_weight"))
    below = filling.select((F.col("bound") / F.col("weight")).alias("full"), "place", level.alias("level")).filter("level <= full")
    level = below.agg(F.min(F.struct("full", "place", "level")).alias("first")).select(F.coalesce("first.level", F.lit(0.0))).first()[0]
    target = F.least(F.col("bound").cast("double"), F.lit(level) * F.col("weight"))
    return placed.select("source", "place", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weigh: Callable = alike, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, epochs, part, quality, sample_key) of every row.

    The mix takes each row ``epochs`` times whole and its first ``part`` words once more; ``taken`` is the sum in words. A null text has
    no words and none is taken of it. A null source is a source of its own, the last. Rows are told by their
    place in the input: null and repeated ids are rows like others, and equal rows, whose keys are equal, are ordered by that place. An empty table
    gives no rows, a table without words targets of 0; other columns are ignored.
    """
    rows = written(measured(docs, weigh, id_col, text_col, source_col).withColumn("row", F.monotonically_increasing_id()))
    sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_epochs))
    uniform = (F.shiftrightunsigned("draw", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    key = -F.log(uniform) / F.greatest("quality", F.lit(LEAST_QUALITY))
    known = sources.withColumnRenamed("source", "of")
    keyed = rows.join(known, F.col("source").eqNullSafe(F.col("of"))).withColumn("sample_key", key).select("doc_id", "source", "place", "source_size", "target", "size", "quality", "sample_key", "draw", "row")
    ordered = running(keyed, [F.col("place"), F.col("sample_key"), F.col("draw"), F.col("row")], ["size"])
    # what the sources before hold comes off again
    starts = running(sources.select("place", "source_size"), [F.col("place")], ["source_size"]).select("place", F.col("before_source_size").alias("start"))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("int")
    epochs = F.least(epochs, F.lit(most_epochs))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("before_size") - F.col("start"))))
    placed = ordered.join(starts, "place").withColumns({"epochs": epochs, "part": part})
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part", "quality", "sample_key")


def texts(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, epoch, text): the texts of the mix, a whole one for each epoch and then the first words of those taken in part.

    Rows are found by id, which must tell the rows of ``docs`` apart; rows without an id are left out.
    """
    taken = mixed.filter("taken > 0").select(F.col("doc_id").alias("of"), "epochs", "part", "size")
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(taken, F.col("doc_id") == F.col("of"))
    each = found.select("doc_id", "text", "part", "size", "epochs", F.explode(F.sequence(F.lit(1), F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0))).alias("epoch"))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("part").cast("int")), "")
    whole = (F.col("epoch") <= F.col("epochs")) | (F.col("part") == F.col("size"))
    return each.select("doc_id", "epoch", F.when(whole, F.col("text")).otherwise(first).alias("text"))
