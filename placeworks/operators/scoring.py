"""Loose pairs of record linkage scored by blocks (E05, E06): the score ladder over whole chunks of targets and rows, of which the best rows a target leave a task."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeworks.functions.text import floors, name_variants
from placeworks.operators.blocks import MOST, STEP, Sets, gathered, in_chunks, prefix, spread

BUCKETS, FOUND = 384, "target long, row long, score int"


def fields(records: DataFrame, target: bool) -> DataFrame:
    """What scores need of records, without their long texts: whole variants only where they have a branch or building ending; equality is told by hashes of 64 bits."""
    full, base = F.col("name"), F.element_at(name_variants(F.col("name")), -1)
    ending = lambda c: F.when(c.rlike("(?:店|ビル)$"), c)
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    known = lambda c: F.when(c.isNotNull(), F.xxhash64(c)).otherwise(F.lit(0))
    return records.select(
        F.col("id").cast("long").alias("id"), F.lit(target).alias("target"), prefix(full).alias("text"), F.when(base != full, prefix(base)).alias("base"), known(full).alias("h_full"), known(base).alias("h_base"),
        known(F.col("address")).alias("h_address"), known(F.col("street")).alias("h_street"), known(F.when(F.col("city") != "", F.col("city"))).alias("h_city"), F.coalesce("complete", F.lit(False)).alias("complete"),
        F.coalesce(F.concat_ws("|", floors(F.col("address"))), F.lit("")).alias("floors"), (empty(full) | empty(F.col("address"))).alias("blank"), ending(full).alias("end_full"), ending(base).alias("end_base"),
    )


def _grams(text: str) -> set[str]:
    return {text[k : k + 2] for k in range(min(len(text), MOST) - 1)}


class Records:
    """Fields of the records of a task, and the scores of pairs of them."""

    def __init__(self, table: pa.Table):
        self.of = {c: table[c].to_numpy() for c in ("id", "target", "h_full", "h_base", "h_address", "h_street", "h_city", "complete", "blank")}
        base = table["base"].to_pylist()
        self.special = np.array([b is not None for b in base], bool)
        self.sets = Sets([*table["text"].to_pylist(), *(b for b in base if b is not None)])
        at = np.arange(len(base))
        self.place = {"full": at, "base": np.where(self.special, len(base) + np.cumsum(self.special) - 1, at)}
        self.ends = {v: table[f"end_{v}"].to_pylist() for v in ("full", "base")}
        levels = sorted(set(table["floors"].to_pylist()))
        known = [set(x.split("|")) if x else set() for x in levels]
        self.floor = np.searchsorted(np.array(levels), np.array(table["floors"].to_pylist()))
        self.apart = np.array([[bool(x and y and not x & y) for y in known] for x in known])

    def like(self, t: np.ndarray, r: np.ndarray, v: str, w: str) -> np.ndarray:
        """Similarity of a variant of each target to one of each row; a shared branch or building ending of four characters or more goes first."""
        out = self.sets.dice(self.place[v][t], self.place[w][r])
        rows = defaultdict(list)
        for j, k in enumerate(r):
            if self.ends[w][k]:
                rows[self.ends[w][k][-4:]].append((j, self.ends[w][k]))
        for i, k in enumerate(t if rows else ()):
            x = self.ends[v][k]
            for j, y in rows.get(x[-4:], ()) if x and len(x) >= 4 else ():
                short, n = min(len(x), len(y)), 4
                while n < short and x[-n - 1] == y[-n - 1]:
                    n += 1
                if n < short:
                    a, b = _grams(x[:-n]), _grams(y[:-n])
                    out[i, j] = 2.0 * len(a & b) / (len(a) + len(b)) if a or b else 0.0
        out[self.of[f"h_{v}"][t][:, None] == self.of[f"h_{w}"][r]] = 1.0
        return out

    def scores(self, t: np.ndarray, r: np.ndarray) -> np.ndarray:
        like = self.like(t, r, "full", "full")
        same = lambda a, b=None: self.of[a][t][:, None] == self.of[b or a][r]
        alias = same("h_full") | same("h_full", "h_base") | same("h_base", "h_full") | same("h_base")
        for v, w, i, j in (("full", "base", ..., self.special[r]), ("base", "full", self.special[t], ...), ("base", "base", self.special[t], self.special[r])):
            i, j = (np.arange(n) if x is ... else np.flatnonzero(x) for x, n in ((i, len(t)), (j, len(r))))
            if len(i) and len(j):
                like[np.ix_(i, j)] = np.maximum(like[np.ix_(i, j)], self.like(t[i], r[j], v, w))
        present = lambda c: same(c) & (self.of[c][r] != 0)
        street, city, address = present("h_street") & self.of["complete"][t][:, None] & self.of["complete"][r], present("h_city"), present("h_address")
        out = np.select([same("h_full") & address, alias & address, street & (alias | (like >= 0.45)), city & (alias | (like >= 0.7)), street & (like >= 0.3), city & (like >= 0.55)], [400, 300, 200, 100, 50, 50], 0).astype(np.int32)
        np.minimum(out, 100, out=out, where=self.apart[self.floor[t]][:, self.floor[r]])
        out[self.of["blank"][t]] = 0
        out[:, self.of["blank"][r]] = 0
        return out

    def best(self, t: np.ndarray, r: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
        """The ``most`` rows of each target by score, smaller ids first, of those that score."""
        r = r[np.argsort(self.of["id"][r], kind="stable")]
        for k in range(0, len(t) if len(r) else 0, STEP):
            a = t[k : k + STEP]
            score = self.scores(a, r)
            nth = np.argsort((400 - score).astype(np.int16), axis=1, kind="stable")[:, :most]
            i, j = np.repeat(np.arange(len(a)), nth.shape[1]), nth.ravel()
            kept = score[i, j] > 0
            i, j = i[kept], j[kept]
            yield pa.RecordBatch.from_arrays([pa.array(self.of["id"][a[i]]), pa.array(self.of["id"][r[j]]), pa.array(score[i, j])], ["target", "row", "score"])


def of_names(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """(target, row, score) of pairs of one name and city; who has the address too is an exact pair, and none of these."""
    usable = lambda df: df.filter("not blank and h_city != 0").select("id", "h_full", "h_city", "h_street", "complete", "floors")
    t, r = usable(targets).alias("t"), usable(rows).alias("r")
    street = (F.col("t.h_street") == F.col("r.h_street")) & (F.col("t.h_street") != 0) & F.col("t.complete") & F.col("r.complete")
    apart = (F.col("t.floors") != "") & (F.col("r.floors") != "") & ~F.arrays_overlap(F.split("t.floors", "[|]"), F.split("r.floors", "[|]"))
    met = t.join(r, (F.col("t.h_full") == F.col("r.h_full")) & (F.col("t.h_city") == F.col("r.h_city")))
    return met.select(F.col("t.id").alias("target"), F.col("r.id").alias("row"), F.when(street & ~apart, 200).otherwise(100).alias("score"))


def of_streets(targets: DataFrame, rows: DataFrame, most: int, chunk: int) -> DataFrame:
    """(target, row, score) of the best rows of the target's street, from each of its chunks of records (of ``fields`` and a street)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gathered(batches)
        own, x, y = (table[c].to_numpy() for c in ("own", "x", "y"))
        records, is_target = Records(table), table["target"].to_numpy()
        for u, v in {(x[0], y[0]), (y[0], x[0])}:
            yield from records.best(np.flatnonzero(is_target & (own == u)), np.flatnonzero(~is_target & (own == v)), most)

    dealt = in_chunks(targets.unionByName(rows), ["street"], "id", chunk)
    return spread(dealt, "street", "x", "y").groupBy("street", "x", "y").applyInArrow(scored, FOUND)


def of_blocks(targets: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(target, row, score) of the best rows of each block (city, gram) of a target; both sides are ``fields`` with their blocks. A task has several blocks."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gathered(batches)
        block, is_target = table["block"].to_numpy(), table["target"].to_numpy()
        if is_target.all() or not is_target.any():
            return
        records = Records(table)
        order = np.argsort(block, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            yield from records.best(own[is_target[own]], own[~is_target[own]], most)

    key: Column = F.xxhash64("city", "gram")
    dealt = targets.unionByName(rows).withColumn("block", key).withColumn("bucket", F.pmod("block", F.lit(BUCKETS)).cast("int")).drop("city", "gram")
    return spread(dealt, "bucket").groupBy("bucket").applyInArrow(scored, FOUND)
