"""Toxicity by a small convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed vectors of the word and of its first 3 to 6 bytes, so
inflected and compounded forms share weight. Filters of width 1, 2 and 3 run over the words;
each filter's maximum over the text feeds a logistic output. All weights start at random and are learned together. Because the
first layer is linear, a word's contribution to each filter tap is a table row: scoring looks up
one row for each distinct word of a slice.

Of the labelled documents a part trains, a part says after which epoch to stop, and a part calibrates the thresholds
by language. The language is that of ``language_id``, told from the text alone.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeworks.llm import language_id
from placeworks.llm import textkit as tk
from placeworks.llm.store import bounded_rows

TOXIC_SAMPLE, CLEAN_SAMPLE, SAMPLE_BYTES = 1500, 3500, 64 << 20
BUCKETS, SIZE, FILTERS, WIDTHS, EPOCHS, RATE, DROPPED = 1 << 15, 12, 10, (1, 2, 3), 14, 0.01, 0.1
PREFIXES = (3, 4, 5, 6)


@dataclass
class Tokens:
    """Words of some documents: index into the distinct words, document of each, features of the distinct words."""

    word: np.ndarray
    doc: np.ndarray
    n_docs: int
    parts: np.ndarray  # distinct words x (1 + prefixes), buckets


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    low = tk.lower_latin(data)
    starts, ends, doc = tk.letter_words(low, offsets)
    h = tk.span_hashes(low, starts, ends)
    distinct, first, word = np.unique(h, return_index=True, return_inverse=True)
    length = ends[first] - starts[first]
    parts = [distinct] + [tk.span_hashes(low, starts[first], starts[first] + np.minimum(length, k)) ^ np.uint64(k) for k in PREFIXES]
    buckets = np.stack([(tk.mix(p) % np.uint64(BUCKETS)).astype(np.int32) for p in parts], 1) if len(distinct) else np.zeros((0, 1 + len(PREFIXES)), np.int32)
    return Tokens(word.astype(np.int64), doc, len(offsets) - 1, buckets)


@dataclass
class Network:
    embedding: np.ndarray
    taps: np.ndarray  # all filter taps side by side: SIZE x (sum of widths * FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: dict[str, float] = field(default_factory=dict)  # logit of the threshold, by language; of all others under ""
    dictionaries: dict[str, bytes] = field(default_factory=dict)  # of the languages

    def word_taps(self, parts: np.ndarray) -> np.ndarray:
        return self.embedding[parts].sum(1) @ self.taps

    def pooled(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of each filter over each document (0 at least) and the positions that made them, -1 for none."""
        rows = self.word_taps(t.parts)
        maxima = np.zeros((t.n_docs, len(WIDTHS) * FILTERS), np.float32)
        at = np.full(maxima.shape, -1, np.int64)
        column = 0
        for k, width in enumerate(WIDTHS):
            last = len(t.word) - width + 1
            whole = np.flatnonzero(t.doc[:last] == t.doc[width - 1 :]) if last > 0 else np.zeros(0, int)
            if len(whole):
                a = np.repeat(self.bias[None, k * FILTERS : (k + 1) * FILTERS], len(whole), 0)
                for j in range(width):
                    a += rows[t.word[whole + j], column + j * FILTERS : column + (j + 1) * FILTERS]
                docs, begin = np.unique(t.doc[whole], return_index=True)
                most = np.maximum.reduceat(a, begin, 0)
                block = slice(k * FILTERS, (k + 1) * FILTERS)
                maxima[docs, block] = np.maximum(most, 0)
                hit = np.flatnonzero((a == most[np.searchsorted(docs, t.doc[whole])]).any(1))
                for f in range(FILTERS):
                    here = hit[a[hit, f] == most[np.searchsorted(docs, t.doc[whole[hit]]), f]]
                    at[t.doc[whole[here[::-1]]], k * FILTERS + f] = whole[here[::-1]]
                at[docs, block] = np.where(most > 0, at[docs, block], -1)
            column += width * FILTERS
        return maxima, at

    def logits(self, t: Tokens) -> np.ndarray:
        return self.pooled(t)[0] @ self.out + self.out_bias

    def score(self, t: Tokens, languages: list[str]) -> np.ndarray:
        shift = np.array([self.shift.get(x, self.shift.get("", 0.0)) for x in languages])
        return 1 / (1 + np.exp(-np.clip(self.logits(t) - shift, -500, 500)))


Batches = list[tuple[Tokens, np.ndarray]]


def _loss(net: Network, batches: Batches, weight: tuple[float, float]) -> float:
    total = 0.0
    for t, y in batches:
        z = net.logits(t)
        total += float((np.where(y == 1, weight[1], weight[0]) * np.logaddexp(0, np.where(y == 1, -z, z))).sum())
    return total


def train(batches: Batches, weight: tuple[float, float], watched: Batches = (), epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Network:
    """Adam on the weighted logistic loss; only the positions that won a maximum carry a gradient.

    Everything starts at random. A share ``DROPPED`` of the words is left out at each step, so that no single one is learned by heart.
    Of all epochs, the state with the least loss on ``watched`` is returned (without these the last one).
    """
    rng = np.random.default_rng(seed)
    n_taps = sum(WIDTHS) * FILTERS
    net = Network(rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32), rng.normal(0, 0.3, (SIZE, n_taps)).astype(np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), -1.0)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in vars(net).items() if isinstance(v, np.ndarray)}
    state["out_bias"] = (np.zeros(1), np.zeros(1))
    step, best = 0, (np.inf, net)

    def adam(name, value, grad, rows=slice(None)):
        m, v = state[name]
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        return value - rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-6)

    for _ in range(epochs):
        for which in rng.permutation(len(batches)):
            t, y = batches[which]
            step += 1
            stay = rng.random(len(t.word)) >= DROPPED
            t = Tokens(t.word[stay], t.doc[stay], t.n_docs, t.parts)
            pooled, at = net.pooled(t)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -500, 500)))
            g = ((p - y) * np.where(y == 1, weight[1], weight[0]) / len(y)).astype(np.float32)
            back = g[:, None] * net.out[None] * (at >= 0)
            grad_out, grad_bias = pooled.T @ g + 1e-4 * net.out, back.sum(0)
            grad_taps = 1e-4 * net.taps
            buckets, into = [np.zeros(0, np.int32)], [np.zeros((0, SIZE), np.float32)]
            column = 0
            for k, width in enumerate(WIDTHS):
                for f in range(FILTERS):
                    docs = np.flatnonzero(at[:, k * FILTERS + f] >= 0)
                    for j in range(width):
                        tap = column + j * FILTERS + f
                        parts = t.parts[t.word[at[docs, k * FILTERS + f] + j]]
                        b = back[docs, k * FILTERS + f]
                        grad_taps[:, tap] += net.embedding[parts].sum(1).T @ b
                        buckets.append(parts.ravel())
                        into.append(np.repeat(b[:, None] * net.taps[None, :, tap], parts.shape[1], 0))
                column += width * FILTERS
            buckets, into = np.concatenate(buckets), np.concatenate(into)
            order = np.argsort(buckets, kind="stable")
            rows, begin = np.unique(buckets[order], return_index=True)
            if len(rows):
                net.embedding[rows] = adam("embedding", net.embedding[rows], np.add.reduceat(into[order], begin, 0), rows)
            net.taps = adam("taps", net.taps, grad_taps)
            net.bias = adam("bias", net.bias, grad_bias)
            net.out = adam("out", net.out, grad_out)
            net.out_bias = float(adam("out_bias", np.array([net.out_bias]), np.array([g.sum()]))[0])
        if watched:
            loss = _loss(net, watched, weight)
            if loss < best[0]:
                best = (loss, copy.deepcopy(net))
    return best[1] if watched and epochs else net


def calibrate(net: Network, held: Batches, languages: list[list[str]], weight: tuple[float, float]) -> None:
    """For each language the logit that separates its held documents with the least weighted error,
    midway between neighbours; languages without both classes take the threshold over all."""
    logit = np.concatenate([net.logits(t) for t, _ in held]) if held else np.zeros(0)
    y = np.concatenate([y for _, y in held]) if held else np.zeros(0)
    language = np.array([x for some in languages for x in some], str)

    def best(of: np.ndarray) -> float | None:
        s, t = logit[of], y[of]
        if len(np.unique(t)) < 2:
            return None
        order = np.argsort(s)
        s, t = s[order], t[order]
        wrong = np.concatenate(([0.0], np.cumsum(np.where(t == 1, weight[1], -weight[0])))) + weight[0] * (t == 0).sum()
        cuts = np.concatenate(([s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]))
        good = np.flatnonzero(wrong <= wrong.min() + 1e-9)
        return float(cuts[good[len(good) // 2]])

    overall = best(np.ones(len(y), bool))
    net.shift[""] = 0.0 if overall is None else overall
    for k in np.unique(language):
        own = best(language == k)
        # A few documents say little about a language: its cut is drawn to the common one.
        n = float((y[language == k] == 1).sum())
        if own is not None:
            net.shift[str(k)] = (n * own + 5 * net.shift[""]) / (n + 5)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, toxic: int, clean: int, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, label, text) of at most ``toxic`` and ``clean`` labelled documents, those of the smallest id hash, as far as their texts fit into
    ``sample_bytes`` together: a text that does not fit any more is passed over, shorter ones after it still count. Of a repeated id the shortest text
    counts; null labels and texts are passed over. Only lengths of the bounded sample are looked at together, texts stay where they are."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).distinct()
    some = bounded_rows(known.filter("label = 1"), "doc_id", toxic).unionByName(bounded_rows(known.filter("label = 0"), "doc_id", clean))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.octet_length(text_col).alias("bytes"), F.xxhash64(text_col).alias("text_hash"))
    which = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("bytes", "text_hash")).alias("one"))
    sizes = which.select("doc_id", "label", "one.*").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "label").toArrow()
    taken, left = [], sample_bytes
    for size in sizes["bytes"].to_pylist():
        taken.append(size <= left)
        left -= size if taken[-1] else 0
    picked = docs.sparkSession.createDataFrame(sizes.filter(pa.array(taken, pa.bool_())))
    return texts.join(F.broadcast(picked), ["doc_id", "bytes", "text_hash"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def batched(texts: list[str], y: np.ndarray, size: int = 64) -> Batches:
    out = []
    for k in range(0, len(texts), size):
        (_, _, data, offsets), *_ = tk.text_slices(pa.array(texts[k : k + size], pa.string()), 1 << 40)
        out.append((tokens(data, offsets), y[k : k + size]))
    return out


def fit(texts: list[str], y: np.ndarray, weight: tuple[float, float], dictionaries: dict[str, bytes]) -> Network:
    """A trained and calibrated network: of the texts, dealt by a fixed permutation, seven tenths train, three of twenty
    choose the epoch, the rest calibrates. With one class only every text is of that class."""
    if len(np.unique(y)) < 2:
        net = train([], weight, epochs=0)
        net.out[:], net.out_bias = 0, 5.0 if len(y) and y[0] == 1 else -5.0
        return net
    order = np.random.default_rng(3).permutation(len(y))
    used, watched, held = np.split(order, [len(y) * 7 // 10, len(y) * 17 // 20])
    batches = lambda which: batched([texts[k] for k in which], y[which])
    balance = (1.0, min(4.0, (y == 0).sum() / max(1, (y == 1).sum())))
    net = train(batches(used), balance, batches(watched))
    net.dictionaries = dictionaries
    coders = language_id.Coders(dictionaries)
    # The documents that chose the epoch help to calibrate: their logits were not fitted either, and languages are small.
    both = np.concatenate((watched, held))
    calibrate(net, batches(both), [[coders.best(texts[k])[0] for k in both]], weight)
    return net


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE, dictionaries: dict[str, bytes] | None = None) -> Network:
    """Train on the sample of ``labelled_texts``. ``dictionaries`` are those of ``language_id.learn``; without them there is one threshold."""
    counts = {r["label"]: r["count"] for r in labels.select(F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").groupBy("label").count().collect()}
    rows = labelled_texts(docs, labels, id_col, text_col, label_col, toxic, clean).toArrow().to_pandas().sort_values(["doc_id", "label"])
    y = rows["label"].to_numpy()
    weight = (max(1.0, counts.get(0, 0) / max(1, (y == 0).sum())), max(1.0, counts.get(1, 0) / max(1, (y == 1).sum())))
    return fit(rows["text"].tolist(), y, weight, dictionaries or {})


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, language) of every row; predicted is 1 at a score of 0.5 or more.

    Texts without letters, null ones too, have no maxima: the output's bias is their score, under the threshold of all languages. Repeated rows
    give repeated results, an empty table none; other columns are ignored.
    """
    weights = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches):
        net = weights.value
        coders = language_id.Coders(net.dictionaries)
        for b in batches:
            s, languages = [np.zeros(0)], []
            for first, last, data, offsets in tk.text_slices(b.column(1)):
                own = [coders.best(b.column(1)[k].as_py())[0] for k in range(first, last)]
                s.append(net.score(tokens(data, offsets), own))
                languages += own
            s = np.concatenate(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.astype(float)), pa.array((s >= 0.5).astype(np.int32)), pa.array(languages, pa.string())], names=["doc_id", "score", "predicted", "language"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double, predicted int, language string")
