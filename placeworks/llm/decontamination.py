"""Benchmark decontamination: rare n-gram seeds, an exact bound on shared words, then Smith-Waterman alignment.

1. Every n-gram of the test items that the documents hold is a seed; a pass over all documents counts how often.
2. Documents are joined to items on the seeds: the seeds of a block of items are broadcast, and blocks are cut
   so that their texts stay below ``BLOCK_BYTES``; documents are never shuffled.
3. A sufficient alignment must match a share of the item's words and can shift by a bounded number of words. Documents, and then
   passages around seeds, that hold too few of the item's words are left out, which loses nothing.
4. In what is left a passage is aligned with the item, word by word, those around the rarest seeds first. The score is the share of the
   best possible one, so substituted, added or dropped words lower it but do not hide a copy. A passage of commoner seeds is
   left out only where the words it shares with the item cannot give a better score than one already found, or, if
   documents are only filtered, where the document has been found to hold an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeworks.llm import textkit as tk
from placeworks.llm.membership import split
from placeworks.llm.store import written

SEED_WORDS, MATCH, MISMATCH, GAP, THRESHOLD, BLOCK_BYTES = 3, 2, -1, -1, 0.5, 8 << 20
#: Rows that are looked up at once.
ROWS = 1 << 20
_U = np.uint64


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the lower-cased words, their documents, and the bytes they span."""
    low = tk.lower_latin(data)
    starts, ends, doc = tk.letter_words(low, offsets)
    return tk.span_hashes(low, starts, ends), doc, starts, ends


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment: its score and the end in the passage. One vector step for each word
    of the item; gaps along the passage are a running maximum."""
    at = np.arange(len(passage), dtype=np.int64)
    row, best, end = np.zeros(len(passage), np.int64), 0, 0
    for word in item:
        diagonal = np.concatenate(([0], row[:-1])) + np.where(passage == word, MATCH, MISMATCH)
        row = np.maximum(np.maximum(diagonal, row + GAP), 0)
        row = np.maximum.accumulate(row - GAP * at) + GAP * at
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k + 1
    return best, end


class Items:
    """A block of test items: their words, and the seeds (hash, item, position) sorted by hash."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        (_, _, data, offsets), *_ = [*tk.text_slices(pa.array(texts, pa.string()), 1 << 40), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))]
        words, doc, _, _ = words_of(data, offsets)
        ends = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.words = [words[ends[k] : ends[k + 1]] for k in range(len(ids))]
        # An item shorter than a seed is a seed as a whole.
        grams, first = tk.gram_hashes(words, doc, SEED_WORDS)
        self.grams, self.item, self.pos = [grams], [doc[first]], [first - ends[doc[first]]]
        for n in range(1, SEED_WORDS):
            for k, w in enumerate(self.words):
                if len(w) == n:
                    g, _ = tk.gram_hashes(w, np.zeros(n, np.int64), n)
                    self.grams.append(g), self.item.append(np.full(1, k)), self.pos.append(np.zeros(1, np.int64))
        self.grams, self.item, self.pos = (np.concatenate(x) for x in (self.grams, self.item, self.pos))
        self.lengths = sorted({min(SEED_WORDS, len(w)) for w in self.words if len(w)})

        order = np.argsort(self.grams, kind="stable")
        self.grams, self.item, self.pos = self.grams[order], self.item[order], self.pos[order]
        self.vocabulary, self.flat = np.unique(words, return_inverse=True)
        self.begin, self.size = ends[:-1], np.diff(ends)

    def places(self, words: np.ndarray) -> np.ndarray:
        """Where words of the items are, sorted by word and place, as word * (len(words) + 1) + place."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        where = np.flatnonzero(self.vocabulary[at] == words)
        return np.sort(at[where] * (len(words) + 1) + where)

    def shared(self, places: np.ndarray, n: int, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words of each item lie between a and b of the n words that ``places`` is of."""
        out = np.zeros(len(item), np.int64)
        for rows, row, step in _expanded(self.size[item]):
            word = self.flat[self.begin[item[rows]][row] + step] * (n + 1)
            at = np.searchsorted(places, word + a[rows][row])
            found = places[np.minimum(at, len(places) - 1)]
            out[rows] = np.bincount(row, (at < len(places)) & (found < word + b[rows][row]), minlength=rows.stop - rows.start)
        return out


def _expanded(many: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of rows that are repeated ``many`` times, about ``ROWS`` at once: the slice, and the row in it and number of each repetition."""
    total, k = np.concatenate(([0], np.cumsum(many))), 0
    while k < len(many):
        stop = max(k + 1, int(np.searchsorted(total, total[k] + ROWS, "right")) - 1)
        row = np.repeat(np.arange(stop - k), many[k:stop])
        yield slice(k, stop), row, np.arange(len(row)) - (total[k:stop] - total[k])[row]
        k = stop


def _document_grams(words, doc, lengths):
    for n in lengths:
        yield tk.gram_hashes(words, doc, n)


def counted(column: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(seed, n): how often seeds occur in the texts. A seed is told by its first place in ``items.grams``."""
    seeds = np.zeros(len(items.grams) + 1, np.int64)
    for _, _, data, offsets in tk.text_slices(column):
        words, doc, _, _ = words_of(data, offsets)
        for grams, _ in _document_grams(words, doc, items.lengths):
            at = np.searchsorted(items.grams, grams)
            hit = at[items.grams[np.minimum(at, len(items.grams) - 1)] == grams]
            seeds += np.bincount(hit[hit < len(items.grams)], minlength=len(seeds))
    return np.flatnonzero(seeds), seeds[seeds > 0]


def _passages(words, doc, bounds, items: Items, threshold: float, often: np.ndarray):
    """Passages that may hold an item, as (document, item, low, high, count of the rarest seed, words of the item in it)."""
    n, places = len(words), items.places(words)
    slack = np.floor(items.size * MATCH * (1 - threshold)).astype(np.int64)  # words a sufficient alignment can add at most
    spread, shift = 2 * n + int(items.size.max(initial=0)) + 1, int(items.size.max(initial=0))
    kept, rarity = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def rarest(key, count):
        order = np.lexsort((count, key))
        key, first = np.unique(key[order], return_index=True)
        return key, count[order][first]

    for grams, first in _document_grams(words, doc, items.lengths):
        lo, hi = np.searchsorted(items.grams, grams, "left"), np.searchsorted(items.grams, grams, "right")
        at = np.flatnonzero(hi > lo)
        for rows, row, step in _expanded((hi - lo)[at]):
            gram = at[rows][row]
            place, seed = first[gram], lo[gram] + step
            pair, back = np.unique(doc[place] * len(items.ids) + items.item[seed], return_inverse=True)
            owner, item = np.divmod(pair, len(items.ids))
            may = (items.shared(places, n, item, bounds[owner], bounds[owner + 1]) >= threshold * items.size[item])[back]
            key, count = rarest(pair[back[may]] * spread + place[may] - items.pos[seed[may]] + shift, often[lo[gram[may]]])
            kept.append(key), rarity.append(count)
    key, count = rarest(np.concatenate(kept), np.concatenate(rarity))
    pair, begin = np.divmod(key, spread)
    owner, item = np.divmod(pair, max(len(items.ids), 1))
    begin -= shift
    low, high = np.maximum(bounds[owner], begin - slack[item]), np.minimum(bounds[owner + 1], begin + items.size[item] + slack[item])
    may = items.shared(places, n, item, low, high) >= threshold * items.size[item]
    pair, owner, item, low, high, count = (x[may] for x in (pair, owner, item, low, high, count))
    if not len(pair):
        return [pair] * 6
    # Both ends grow within a pair, so those that overlap the one before are one passage with it.
    starts = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (low[1:] > high[:-1]))))
    high = high[np.append(starts[1:], len(pair)) - 1]
    owner, item, low, count = owner[starts], item[starts], low[starts], np.minimum.reduceat(count, starts)
    return owner, item, low, high, count, items.shared(places, n, item, low, high)


def found_in(column: pa.Array, items: Items, threshold: float, often: np.ndarray | None = None, any_item: bool = False) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, score, first byte, byte after the last) of the best copy of each item found in each text, or, with ``any_item``, of
    the first one met in each text. ``often`` has the counts of the seeds; the passages of the rarest come first."""
    often = np.zeros(len(items.grams), np.int64) if often is None else often
    for first_row, _, data, offsets in tk.text_slices(column):
        words, doc, starts, ends = words_of(data, offsets)
        bounds = np.searchsorted(doc, np.arange(len(offsets)))
        owner, item, low, high, count, shared = _passages(words, doc, bounds, items, threshold, often)
        order = np.lexsort((low, count, owner) if any_item else (low, count, item, owner))
        best: dict[tuple[int, int], tuple] = {}
        for d, k, a, b, most in zip(*(x[order].tolist() for x in (owner, item, low, high, shared))):
            key = (d, -1 if any_item else k)
            known = best.get(key)
            # Each word of the item matches once, so the shared words bound the score; of equal scores the first in the text stays.
            if known and (any_item or (MATCH * most, -a) <= known[:2]):
                continue
            target, passage = items.words[k], words[a:b]
            score, end = align(target, passage)
            if score / (MATCH * len(target)) >= threshold and (not known or (score, -a) > known[:2]):
                _, back = align(target[::-1], passage[:end][::-1])
                best[key] = (score, -a, k, int(starts[a + end - back]), int(ends[a + end - 1]))
        for (d, _), (score, _, k, begin, end) in best.items():
            yield first_row + d, k, score / (MATCH * len(items.words[k])), begin - int(offsets[d]), end - int(offsets[d])


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int) -> list[DataFrame]:
    """Blocks of items. They are halved until none is larger than ``block_bytes``, unless by a single item."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    block = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    while size > block_bytes and not items.distinct().groupBy(block(n)).agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("items")).filter((F.col("size") > block_bytes) & (F.col("items") > 1)).isEmpty():
        n *= 2
    return [items.filter(block(n) == k).distinct() for k in range(n)]


def _seeds(texts: DataFrame, block: DataFrame):
    """Broadcasts of a block of items and of the counts of its seeds in ``texts``, which has one column. Both are bounded by the
    bytes of a block; counts are summed in each task before they are shuffled."""
    context = texts.sparkSession.sparkContext
    some = block.toArrow().to_pandas().sort_values(["item_id", "text"])
    items = Items(some["item_id"].tolist(), some["text"].tolist())
    shared, often = context.broadcast(items), np.zeros(len(items.grams), np.int64)

    def counts(batches):
        for b in batches:
            seed, n = counted(b.column(0), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(seed, pa.int64()), pa.array(n, pa.int64())], names=["seed", "n"])

    if len(often):
        rows = texts.mapInArrow(counts, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
        often[rows["seed"].to_numpy()] = rows["n"].to_numpy()
    return shared, context.broadcast(often)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, begin, end, passage): each item found in each document, where its best copy lies
    (bytes of the UTF-8 text; of equal ones the first) and the copy itself.

    Every block of items reads the documents twice; where there are several, what one finds is written, and its broadcasts go, before the next.

    Null texts and items, and ones without letters, match nothing. Repeated rows give repeated results, repeated items one; an empty
    table on either side gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(items, often):
        def found(batches):
            for b in batches:
                rows = list(found_in(b.column(1), items.value, threshold, often.value))
                texts = [b.column(1)[r[0]].as_py().encode()[r[3] : r[4]].decode() for r in rows]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), pa.array([items.value.ids[k] for k in columns[1]], pa.int64()), *(pa.array(c, t) for c, t in zip(columns[2:], (pa.float64(), pa.int64(), pa.int64()))), pa.array(texts, pa.string())], names=["doc_id", "item_id", "score", "begin", "end", "passage"])

        return base.mapInArrow(found, "doc_id long, item_id long, score double, begin long, end long, passage string")

    blocks, out = _blocks(benchmark, item_col, item_text_col, block_bytes), None
    for block in blocks:
        items, often = _seeds(base.select("text"), block)
        some = search(items, often)
        if len(blocks) > 1:
            some = written(some)
            items.destroy(), often.destroy()
        out = some if out is None else out.unionByName(some)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no test item is found, with all their columns.

    With several blocks of items each writes the keys (two hashes) of the texts it finds, and rows are told apart by all of them at once.
    Null and empty texts are clean; repeated rows stay or go together; an empty benchmark keeps all rows, and an empty table has none.
    """
    text = F.col(text_col).cast("string")
    blocks, hits = _blocks(benchmark, item_col, item_text_col, block_bytes), None
    key = {"first": F.xxhash64(text), "second": F.xxhash64(F.lit(1), text)}

    def clean(rows, at, items, often, inside):
        def sifted(batches):
            for b in batches:
                keep = np.full(b.num_rows, not inside)
                keep[[r[0] for r in found_in(b.column(at).cast(pa.string()), items.value, threshold, often.value, any_item=True)]] = inside
                yield b.filter(pa.array(keep))

        return rows.mapInArrow(sifted, rows.schema)

    for block in blocks:
        items, often = _seeds(docs.select(text), block)
        if len(blocks) == 1:
            return clean(docs, docs.columns.index(text_col), items, often, False)
        some = written(clean(docs.select(text.alias("text"), *[e.alias(k) for k, e in key.items()]), 0, items, often, True).select(*key).distinct())
        items.destroy(), often.destroy()
        hits = some if hits is None else hits.unionByName(some)
    return split(docs, key, written(hits.distinct()))[1]
