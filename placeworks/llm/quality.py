"""Document quality by Bradley-Terry ranking of preference pairs.

A document's strength is linear in features of its text; the weights maximise the likelihood
that in each pair of a good and a poor labelled document the good one wins, a logistic loss on the
difference of their features. All labelled documents and all their pairs count. A pair's weight in a Newton step hangs on the
difference of two strengths only, so documents of a class are summed over narrow ranges of strength, and ranges are paired
at their mean strengths, not documents. The cut is a quantile of the strengths of all labelled documents: the share of poor
ones. The score is a logistic curve through the cut, where it is ``CUT_SCORE``.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeworks.llm import textkit as tk
from placeworks.llm.membership import MAX_KEYS, bloom, hits
from placeworks.llm.store import written

CUT_SCORE, PENALTY, STEPS, CLOSE = 0.7, 1e-3, 25, 1e-4
#: Ranges of strengths of a class, slots in the search of a quantile, and the fraction of which summed values are multiples.
RANGES, SLOTS, FRACTION = 1024, 1024, 1 << 20
FEATURES = ("log_words", "word_length", "letters", "capitals", "digits", "symbols", "lone_symbols", "symbol_tails", "doubled_marks", "repeats_next", "distinct", "distinct_for_length", "distinct_lines", "sentence_ends")

_ROW, _COLUMN = np.triu_indices(len(FEATURES))
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document of a slice; all zero without words."""
    n = len(offsets) - 1
    starts, ends, doc = tk.space_words(data, offsets)
    words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(words, 1)
    per_doc = lambda of, weights=None: np.bincount(doc if of is None else doc[of], weights, minlength=n)
    cum = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    total = lambda mask: (c := cum(mask))[offsets[1:]] - c[offsets[:-1]]
    chars = np.maximum(total((data & 0xC0) != 0x80), 1)
    symbols, letters = cum(_SYMBOL[data]), cum(_LETTER[data])
    in_word = letters[ends] - letters[starts]
    marks = symbols[ends] - symbols[starts]
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    before = data[np.maximum(ends - 2, starts)] if len(ends) else last
    doubled = (last == before) & (ends - starts > 2) & ~_LETTER[last] & ~_DIGIT[last]
    h = tk.span_hashes(tk.lower_ascii(data), starts, ends)
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) if len(h) else np.zeros(0, int)
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][fresh], minlength=n)
    l0, l1, ldoc = tk.spans(data != 10, offsets)
    lh = tk.span_hashes(data, l0, l1)
    lines = np.bincount(ldoc, minlength=n)
    lorder = np.lexsort((lh, ldoc))
    lfresh = np.ones(len(lh), bool)
    lfresh[1:] = (lh[lorder][1:] != lh[lorder][:-1]) | (ldoc[lorder][1:] != ldoc[lorder][:-1])
    out = np.stack([
        np.log1p(words),
        per_doc(None, in_word.astype(float)) / some,
        total(_LETTER[data] & ((data & 0xC0) != 0x80)) / chars,
        total(_CAPITAL[data]) / chars,
        total(_DIGIT[data]) / chars,
        np.tanh(8 * total(_SYMBOL[data]) / chars),
        np.tanh(8 * per_doc((in_word == 0) & (marks > 0)) / some),
        np.tanh(8 * per_doc((in_word > 0) & (marks > 1)) / some),
        np.tanh(8 * per_doc(doubled) / some),
        np.tanh(4 * per_doc(same) / some),
        distinct / some,
        distinct / some**0.8,
        np.bincount(ldoc[lorder][lfresh], minlength=n) / np.maximum(lines, 1),
        np.tanh(4 * per_doc(_STOP[last]) / some),
    ], axis=1)
    out[words == 0] = 0
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights of the standardised features, and the logistic curve through the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    width: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at = (self.strength(x) - self.cut) / self.width + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


def fit(rows: DataFrame, penalty: float = PENALTY) -> Ranking:
    """The ranking of all labelled rows (label, x), which are read once a Newton step. With one class only there are no pairs: weights are zero
    and every document scores alike, above the cut if the class is the good one."""
    mean, scale, good, poor = _moments(rows)
    w = np.zeros(len(FEATURES))
    if not good or not poor:
        return Ranking(mean, scale, w, 1.0 if poor else -1.0, 1.0)
    reach = 0.0  # bounds the strengths; standardised features are within 6
    for _ in range(STEPS):
        sums = _ranges(rows, Ranking(mean, scale, w, 0.0, 1.0), reach)
        step = _newton(*sums, w, penalty)
        furthest = max(abs(part[:, 1 : 1 + len(w)] @ w / part[:, 0]).max() for part in sums) + 2 * reach / RANGES
        w = w + step
        reach = min(6 * abs(w).sum(), furthest + 6 * abs(step).sum())
        if abs(step).max() < CLOSE:
            break
    strengths = written(_strengths(rows, Ranking(mean, scale, w, 0.0, 1.0)))
    cut = sum(nth(strengths, poor)) / 2  # the quantile at the share of poor documents, midway to the next
    spread = _median(strengths.filter("label = 1"), good) - _median(strengths.filter("label = 0"), poor)
    return Ranking(mean, scale, w, float(cut), max(float(spread) / 12, 1e-6))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Means and deviations of the features, and the number of good and of poor rows. Sums are decimal, so they don't hang on their order."""
    x = [F.col("x")[k] for k in range(len(FEATURES))]
    exact = lambda value: F.coalesce(F.sum(value.cast("decimal(38,12)")), F.lit(0))
    n, good, *sums = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), *[exact(v) for v in x], *[exact(v * v) for v in x]).first()
    if not n:
        return np.zeros(len(FEATURES)), np.ones(len(FEATURES)), 0, 0
    mean, square = ([Decimal(v) / n for v in part] for part in (sums[: len(x)], sums[len(x) :]))
    deviation = [max(b - a * a, Decimal(0)).sqrt() for a, b in zip(mean, square)]
    return np.array(mean, float), np.array(deviation, float) + 1e-6, good, n - good


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(FEATURES))


def _ranges(rows: DataFrame, ranking: Ranking, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For good and for poor rows, one row a range of strengths, of equal ones from -reach to reach: their number, the sums of their standardised features and of the products of two.
    They are sums of integers, multiples of 1 / FRACTION, so they don't hang on their order."""
    width = 1 + len(FEATURES) + len(_ROW)

    def summed(batches):
        total = np.zeros((2 * RANGES, width), np.int64)
        for b in batches:
            z = ranking.standard(_values(b.column(1)))
            place = np.clip((z @ ranking.weights / reach + 1) / 2 * RANGES, 0, RANGES - 1).astype(int) if reach else np.zeros(len(z), int)
            of = place + RANGES * b.column(0).to_numpy()
            values = np.concatenate((np.ones((len(z), 1)), z, z[:, _ROW] * z[:, _COLUMN]), axis=1)
            _add(total, of, np.rint(values * FRACTION).astype(np.int64))
        yield _occupied(total)

    def together(batches):
        total = np.zeros((2 * RANGES, width), np.int64)
        for b in batches:
            _add(total, b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, width))
        yield _occupied(total)

    schema = "of int, sums array<long>"
    found = rows.select("label", "x").mapInArrow(summed, schema).repartition("of").mapInArrow(together, schema).toArrow().combine_chunks()
    of, sums = found["of"].to_numpy(), np.array(found["sums"].to_pylist(), float) / FRACTION
    order = np.argsort(of)
    of, sums = of[order], sums[order]
    return sums[of >= RANGES], sums[of < RANGES]


def _add(total: np.ndarray, of: np.ndarray, values: np.ndarray) -> None:
    if len(of):
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(of[order]) > 0)))
        total[of[order][starts]] += np.add.reduceat(values[order], starts, axis=0)


def _occupied(total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(total[:, 0])
    ends = pa.array(np.arange(len(some) + 1) * total.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(total[some].ravel()))], names=["of", "sums"])


def _newton(good: np.ndarray, poor: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """The step of the mean logistic loss over all pairs of a good and a poor row, from the sums over ranges."""
    d = len(w)
    (n, x, xx), (m, y, yy) = ((part[:, 0], part[:, 1 : d + 1], part[:, d + 1 :]) for part in (good, poor))
    p = 1 / (1 + np.exp(-np.clip((x @ w / n)[:, None] - (y @ w / m)[None], -500, 500)))
    pairs, lost, curve = n.sum() * m.sum(), 1 - p, p * (1 - p)
    slope = ((lost @ m) @ x - (n @ lost) @ y) / pairs
    square = np.zeros((d, d))
    square[_ROW, _COLUMN] = (curve @ m) @ xx + (n @ curve) @ yy
    square = square + np.triu(square, 1).T
    cross = x.T @ curve @ y
    return np.linalg.solve((square - cross - cross.T) / pairs + penalty * np.eye(d), slope - penalty * w)


def _strengths(rows: DataFrame, ranking: Ranking) -> DataFrame:
    def of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ranking.strength(_values(b.column(1))))], names=["label", "s"])

    return rows.select("label", "x").mapInArrow(of, "label int, s double")


def nth(values: DataFrame, n: int) -> tuple[float, float]:
    """The ``n``-th smallest value of column ``s`` (from 1) and the one after it, or itself if it is the last: counts over ranges of
    values, which narrow until the two are found. Exact, and no value is sorted."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    before, after = 0, high
    while low < high:
        slot = F.least(F.floor((F.col("s") - low) / F.lit(high - low) * SLOTS), F.lit(SLOTS - 1))
        slots = sorted(values.filter(F.col("s").between(low, high)).groupBy(slot.alias("slot")).agg(F.count("*"), F.min("s"), F.max("s")).collect())
        k = 0
        while before + slots[k][1] < n:
            before += slots[k][1]
            k += 1
        if k + 1 < len(slots):
            after = slots[k + 1][2]
        _, count, low, high = slots[k]
        if before + count == n:
            return high, after
    return low, low


def _median(values: DataFrame, n: int) -> float:
    return sum(nth(values, n // 2)) / 2 if n % 2 == 0 else nth(values, n // 2 + 1)[0]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """Fit to all labelled documents, whatever their length: features are joined to labels, texts are not shuffled.

    Null labels and texts are passed over. Of a repeated id each label counts, and of its texts the one whose features come first.
    Without labels, or with one class, every document is of that class (poor without any).
    """
    known = written(labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).distinct())
    texts = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return fit(written(measured(texts, known).join(known, "doc_id").select("label", "x")))


def measured(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, x) of the rows (doc_id, text) whose id is in ``known``, and of a few others that its Bloom filter takes for such ones; of all rows
    where it would be too large. Of a repeated id the features that come first."""
    n = known.count()
    labelled = texts.sparkSession.sparkContext.broadcast(bloom(known.select(F.xxhash64("doc_id")), n)) if n <= MAX_KEYS else None

    def measure(batches):
        for b in batches:
            if labelled is not None:
                b = b.filter(pa.array(hits(labelled.value, b.column(2).to_numpy())))
            x = [features(data, offsets) for _, _, data, offsets in tk.text_slices(b.column(1))]
            flat = np.concatenate(x) if x else np.zeros((0, len(FEATURES)))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(FEATURES), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), values], names=["doc_id", "x"])

    return texts.withColumn("hash", F.xxhash64("doc_id")).mapInArrow(measure, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row: predicted is 1 at a score of ``CUT_SCORE`` or more.

    Texts that are null, empty or of white space have all features zero and are scored so. Repeated rows give
    repeated results, an empty table none; other columns are ignored.
    """

    def scored(batches):
        for b in batches:
            parts = [ranking.score(features(data, offsets)) for _, _, data, offsets in tk.text_slices(b.column(1))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= CUT_SCORE).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    at = docs.columns.index(text_col)

    def kept(batches):
        for b in batches:
            parts = [ranking.score(features(data, offsets)) for _, _, data, offsets in tk.text_slices(b.column(at))]
            yield b.filter(pa.array(np.concatenate(parts) >= CUT_SCORE if parts else np.zeros(0, bool)))

    return docs.mapInArrow(kept, docs.schema)
