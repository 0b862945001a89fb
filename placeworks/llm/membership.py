"""Rows that are in a set of keys, told apart without shuffling the rows.

A Bloom filter of ``BITS_PER_KEY`` bits a key is made in Spark and broadcast; it grows with the keys, so a fixed share of
about 0.3 % of the other rows passes it by chance, however many keys there are. Of those only the keys are
shuffled: the ones that are not in the set are a small second table, and with both a row is judged where it is. Sets of more than ``MAX_KEYS``
keys (a filter of ``MAX_KEYS`` * 2 bytes) are joined instead, which shuffles the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeworks.llm import textkit as tk
from placeworks.llm.store import written

BITS_PER_KEY, HASHES, MAX_KEYS, PAGE_BYTES = 16, 4, 1 << 25, 1 << 9
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_HASH = "__key_hash"


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(tk.mix(hashes.view(np.uint64) ^ seed) & np.uint64(bits - 1)).astype(np.int64) for seed in _SEEDS[:HASHES]]


def bloom(hashes: DataFrame, n: int) -> np.ndarray:
    """Bloom filter, as bytes, of the one long column of ``hashes``, which has about ``n`` values."""
    bits = max(8 * PAGE_BYTES, 1 << (max(1, n) * BITS_PER_KEY - 1).bit_length())

    def spread(batches):
        for b in batches:
            at = np.concatenate(_places(b.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at // (8 * PAGE_BYTES), pa.int32()), pa.array(at % (8 * PAGE_BYTES), pa.int32())], names=["page", "bit"])

    def gathered(batches):
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            page, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(page):
                pages.setdefault(int(k), np.zeros(8 * PAGE_BYTES, bool))[bit[page == k]] = True
        if pages:
            yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int32()), pa.array([np.packbits(x).tobytes() for x in pages.values()], pa.binary())], names=["page", "bits"])

    rows = hashes.mapInArrow(spread, "page int, bit int").repartition("page").mapInArrow(gathered, "page int, bits binary").toArrow()
    out = np.zeros((bits // (8 * PAGE_BYTES), PAGE_BYTES), np.uint8)
    for page, found in zip(rows["page"].to_pylist(), rows["bits"].to_pylist()):
        out[page] = np.frombuffer(found, np.uint8)
    return out.ravel()


def hits(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    hit = np.ones(len(hashes), bool)
    for at in _places(hashes, 8 * len(filter_)):
        hit &= (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return hit


def sift(rows: DataFrame, hash_, filter_, inside: bool = True, innocent=None) -> DataFrame:
    """The rows whose ``hash_`` passes the broadcast filter and is not in ``innocent`` (a broadcast sorted array), or all others."""
    schema = rows.schema

    def sifted(batches):
        known = innocent.value if innocent is not None else np.zeros(0, np.int64)
        for b in batches:
            h = b.column(b.num_columns - 1).to_numpy()
            hit = hits(filter_.value, h)
            if len(known):
                hit &= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] != h
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(hit == inside))

    return rows.withColumn(_HASH, hash_).mapInArrow(sifted, schema)


def split(rows: DataFrame, on: dict, keys: DataFrame, max_keys: int = MAX_KEYS) -> tuple[DataFrame, DataFrame]:
    """(members, others): the rows of ``rows`` whose columns ``on``, by name, are a row of ``keys``, and the rest.

    ``on`` maps the columns of ``keys`` to expressions over ``rows``; neither may be null. Rows keep all columns and repeat as they did;
    an empty set has no members. ``keys`` is read several times, so it should be a written table.
    """
    names, spark = list(on), rows.sparkSession
    keys = keys.select(*names).distinct()
    hidden = {k: f"__key_{j}" for j, k in enumerate(names)}
    renamed = keys.select(*[F.col(k).alias(h) for k, h in hidden.items()])
    n = keys.count()
    if n <= max_keys:
        filter_ = spark.sparkContext.broadcast(bloom(keys.select(F.xxhash64(*names)), n))
        hash_ = F.xxhash64(*on.values())
        suspects = sift(rows.select(*[e.alias(h) for (k, h), e in zip(hidden.items(), on.values())]), F.xxhash64(*hidden.values()), filter_).distinct()
        innocent = written(suspects.join(renamed, list(hidden.values()), "left_anti").select(F.xxhash64(*hidden.values()).alias("h")))
        if innocent.count() <= max(max_keys // 8, 1):
            known = spark.sparkContext.broadcast(np.sort(innocent.toArrow()["h"].to_numpy()))
            return sift(rows, hash_, filter_, True, known), sift(rows, hash_, filter_, False, known)
    keyed = rows.select("*", *[e.alias(hidden[k]) for k, e in on.items()])
    both = lambda how: keyed.join(renamed, list(hidden.values()), how).select(*rows.columns)
    return both("left_semi"), both("left_anti")
