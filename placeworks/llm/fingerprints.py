"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A paragraph is a line that holds a word. One of more than ``LONG_WORDS`` words is cut further, after words whose hash says so
(one in ``CUT_MASK`` + 1), so cuts depend on content alone and one long line can still be compared in part. Each
distinct paragraph's 64-bit digest goes to three cells of a sketch (count, xor of digests, xor of checks).
Subtracting two sketches cancels what the texts share; peeling cells that hold a single digest then
recovers the digests in which they differ. Where a sketch is too small to be peeled, both are made anew four
times as large. The likeness of two texts is the share of their digests that did not differ.

All pairs of a slice are peeled together: their cells lie side by side in a few numpy arrays.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeworks.llm import textkit as tk

CELLS, GROWTH, LONG_WORDS, CUT_MASK = 18, 4, 48, 15
_U = np.uint64
_SEEDS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)]


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paragraph digests of the texts, sorted within each, and each one's text."""
    parts, docs = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for first, _, data, offsets in tk.text_slices(pa.array(texts, pa.string())):
        starts, ends, doc = tk.space_words(data, offsets)
        if not len(starts):
            continue
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        last = np.ones(len(starts), bool)
        last[:-1] = (doc[1:] != doc[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]])
        size = np.diff(np.flatnonzero(last), prepend=-1)
        in_long = np.repeat(size > LONG_WORDS, size)
        if in_long.any():
            last[in_long] |= (tk.span_hashes(data, starts[in_long], ends[in_long]) & _U(CUT_MASK)) == 0
        stop = np.flatnonzero(last)
        begin = np.concatenate(([0], stop[:-1] + 1))
        piece = tk.span_hashes(data, starts[begin], ends[stop])
        owner = doc[begin]
        order = np.lexsort((piece, owner))
        piece, owner = piece[order], owner[order]
        fresh = np.ones(len(piece), bool)
        fresh[1:] = (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])
        parts.append(piece[fresh])
        docs.append(owner[fresh] + first)
    return np.concatenate(parts), np.concatenate(docs)


def _check(keys: np.ndarray) -> np.ndarray:
    return tk.mix(keys ^ _U(0x5851F42D4C957F2D)) & _U(0xFFFFFFFF)


def _cells(keys: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    third = _U(cells // 3)
    return np.stack([owner * cells + j * (cells // 3) + (tk.mix(keys ^ _SEEDS[j]) % third).astype(np.int64) for j in range(3)])


def sketch(keys: np.ndarray, owner: np.ndarray, n: int, cells: int, sign: int = 1, into=None):
    """Sketches of n texts side by side: counts, digest xors, check xors."""
    count, keyed, checked = into or (np.zeros(n * cells, np.int32), np.zeros(n * cells, _U), np.zeros(n * cells, _U))
    if len(keys):
        checks = _check(keys)
        for at in _cells(keys, owner, cells):
            count += (sign * np.bincount(at, minlength=n * cells)).astype(np.int32)
            np.bitwise_xor.at(keyed, at, keys)
            np.bitwise_xor.at(checked, at, checks)
    return count, keyed, checked


def peel(count, keyed, checked, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests recovered on either side of each subtraction, and which of them ended empty."""
    gone = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for _ in range(cells):  # a cell that only looks pure might set off an endless exchange
        pure = np.flatnonzero(np.abs(count) == 1)
        pure = pure[_check(keyed[pure]) == checked[pure]]
        pure = pure[(_cells(keyed[pure], pure // cells, cells) == pure).any(0)]
        if not len(pure):
            break
        key, owner, sign = keyed[pure], pure // cells, count[pure]
        order = np.lexsort((key, owner))
        key, owner, sign = key[order], owner[order], sign[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner, sign = key[fresh], owner[fresh], sign[fresh]
        for side, s in enumerate((1, -1)):
            gone[side] += np.bincount(owner[sign == s], minlength=n)
        checks = _check(key)
        for at in _cells(key, owner, cells):
            np.subtract.at(count, at, sign)
            np.bitwise_xor.at(keyed, at, key)
            np.bitwise_xor.at(checked, at, checks)
    left = ((count != 0) | (keyed != 0) | (checked != 0)).reshape(n, cells).any(1) if n else np.zeros(0, bool)
    return gone[0], gone[1], ~left


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], pairs: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Shared over all digests of each pair (row of a, row of b). Texts without digests are alike."""
    (ka, oa), (kb, ob) = a, b
    bounds = lambda o, rows: (np.searchsorted(o, rows, "left"), np.searchsorted(o, rows, "right"))
    (a0, a1), (b0, b1) = bounds(oa, pairs[:, 0]), bounds(ob, pairs[:, 1])
    na, nb = a1 - a0, b1 - b0
    out = np.ones(len(pairs))
    todo = np.flatnonzero(na + nb > 0)

    def gathered(keys, begin, end):
        size = end - begin
        index = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return keys[index], np.repeat(np.arange(len(size)), size)

    while len(todo):
        failed = []
        step = max(1, (1 << 21) // cells)  # bounds the cells in memory
        for k in range(0, len(todo), step):
            some = todo[k : k + step]
            made = sketch(*gathered(ka, a0[some], a1[some]), len(some), cells)
            made = sketch(*gathered(kb, b0[some], b1[some]), len(some), cells, -1, made)
            only_a, _, whole = peel(*made, len(some), cells)
            shared = na[some] - only_a
            out[some] = np.where(whole, shared / np.maximum(na[some] + nb[some] - shared, 1), out[some])
            failed.append(some[~whole])
        todo, cells = np.concatenate(failed), cells * GROWTH
    return np.clip(out, 0, 1)


def _encoded(keys, owner, n, cells) -> list[str]:
    count, keyed, checked = (x.reshape(n, cells) for x in sketch(keys, owner, n, cells))
    wide = np.concatenate([keyed.astype("<u8").view(np.uint8).reshape(n, -1), count.astype("<u4").view(np.uint8).reshape(n, -1), checked.astype("<u4").view(np.uint8).reshape(n, -1)], 1)
    return [base64.b64encode(row.tobytes()).decode() for row in wide]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; a null text is an empty one. Repeated rows give
    repeated results, an empty table none; other columns are ignored."""

    def made(batches):
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(_encoded(*digests(texts), len(texts), cells), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(made, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, known, at, mark, text, ahead): every row in its range of (id, hash of the text), and at the end of each range
    the first document of the range below (below the lowest: of the highest) as a row that only is ahead.

    Ranges follow the quantiles of the id, one for each partition of the input, and each is one partition: no order over all rows
    is needed. An id of so many rows that several quantiles fall on it is split by the hash of its texts. Null ids come after all others.
    """
    base = docs.select(
        F.col(id_col).isNotNull().alias("known"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("at"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("mark", F.xxhash64("text"))
    n = max(1, docs.rdd.getNumPartitions())
    cuts = np.array(base.approxQuantile("at", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else [], dtype=np.float64)

    @F.pandas_udf("int")
    def place(at: pd.Series, mark: pd.Series) -> pd.Series:
        at = at.to_numpy(np.float64)  # rounded like the cuts
        low, high = (np.searchsorted(cuts, at, side) for side in ("left", "right"))
        share = mark.to_numpy(np.float64) / 2.0**64 + 0.5
        return pd.Series(np.minimum(low + (share * (high - low + 1)).astype(int), high))

    ranged = base.withColumn("range", place("at", "mark"))
    first = F.struct("at", "known", "mark")
    heads = ranged.groupBy("range").agg(F.max(first).alias("head")).orderBy("range").collect()  # a row for each range
    next_range = [(r["range"], *r["head"], heads[(k + 1) % len(heads)]["range"]) for k, r in enumerate(heads)]
    to = docs.sparkSession.createDataFrame(next_range, "range int, at long, known boolean, mark long, goes_to int").select("at", "known", "mark", "goes_to")
    ahead = base.join(F.broadcast(to), ["at", "known", "mark"]).select(F.col("goes_to").alias("range"), "known", "at", "mark", "text", F.lit(True).alias("ahead"))
    return ranged.select("range", "known", "at", "mark", "text", F.lit(False).alias("ahead")).unionByName(ahead).repartitionById(n, "range")


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """Each document against an edited version of itself, and against the next document by falling id.

    The edited text has its last floor(n/2) characters replaced by as many of the next one's first (or
    all of it). Rows of one id follow each other by falling hash of the text, equal rows each other. A null text is empty, null ids come last
    and stay null, one document is its own next; an empty table gives no rows and other columns are ignored.
    """

    def compared(batches):
        held: list[tuple[int | None, str]] = []

        def flush(following):
            texts = [r[1] for r in held]
            nexts = texts[1:] + [following]
            edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts)]
            n = len(texts)
            own, changed, after = digests(texts), digests(edited), digests(nexts)
            line = np.stack([np.arange(n)] * 2, 1)
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in held], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array(_encoded(*own, n, cells), pa.string()), pa.array(_encoded(*changed, n, cells), pa.string()), pa.array(likeness(own, changed, line, cells)), pa.array(likeness(own, after, line, cells)),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        size, now = 0, None
        for b in batches:
            for place, known, at, text, ahead in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(4), b.column(5).to_pylist()):
                text = text.as_py()
                if held and place != now:
                    raise ValueError("a range ends without the document after it")
                if ahead:
                    if held:  # of several documents ahead the first counts
                        yield flush(text)
                    held, size = [], 0
                    continue
                if size > 2 << 20:
                    yield flush(text)
                    held, size = [], 0
                held.append((at if known else None, text))
                size, now = size + len(text), place

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = with_next(docs, id_col, text_col).sortWithinPartitions("range", F.asc("ahead"), F.desc("at"), F.desc("known"), F.desc("mark"))
    return rows.mapInArrow(compared, schema)
