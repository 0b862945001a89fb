"""Token counts without token ids: pieces are counted once per distinct pre-token.

A pre-token is a newline or a run of spaces with the characters that follow up to the next one.
The piece model marks a space in front and no piece holds a newline or a space after another
character, so no piece crosses a pre-token's border and a text's count is the sum over its pre-tokens.

1. Distinct pre-tokens with their corpus frequency: combined within each slice of about 1 MB of text, in Arrow batches, so that
   not every occurrence becomes a row of Spark's; then a hash aggregate, combined map-side.
2. Their piece counts, each computed once, by the tokenizer over the distinct rows.
3. Documents' pre-tokens, as hashes, are summed to per-document frequencies and joined to the counts. The
   most frequent ones (``HEAD`` rows, a fixed bound) are broadcast; only the rare rest is shuffled. So hot
   pre-tokens never meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeworks.llm import textkit as tk
from placeworks.llm.store import written

HEAD, LIMIT = 1 << 18, 4096


def _count(units: list[str], model: str) -> list[int]:
    import public_tokenizers
    import sentencepiece

    global _MODEL
    if _MODEL is None or _MODEL[0] != model:
        _MODEL = (model, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model)))
    # The tokenizer puts a space in front of what it is given: one leading space is left to it, and
    # in front of a newline it makes one piece more. A lone space is that one piece.
    ids = _MODEL[1].encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
    return [1 if u == " " else len(x) - (u[0] == "\n") for u, x in zip(units, ids)]


_MODEL = None


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = 64) -> np.ndarray:
    return (tk.span_hashes(data, starts, ends) >> np.uint64(64 - bits)).view(np.int64)


def _second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of other bytes, so that spans that share the first hash differ in it."""
    return tk.mix(tk.span_hashes(data ^ np.uint8(0x55), starts, ends) ^ np.uint64(0xA0761D6478BD642F)).view(np.int64)


def _pretokens(texts: pa.Array):
    """(first row, row after the last, bytes, starts, ends, rows counted from the first) of the pre-tokens of each slice of non-null texts. A text gets a
    space in front, and the marker that stands for a space is a space, as to the tokenizer; an empty text has one pre-token, which does not count."""
    plain = pc.binary_join_element_wise(" ", pc.replace_substring(texts, "▁", " "), "")
    for first, last, data, offsets in tk.text_slices(plain):
        begins = data == 10
        begins[1:] |= (data[1:] == 32) & (data[:-1] != 32)
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(begins)
        yield first, last, data, starts, np.append(starts[1:], len(data)), np.searchsorted(offsets, starts, "right") - 1


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes data[start:end] of each span as a string."""
    to = np.concatenate(([0], np.cumsum(ends - starts)))
    at = np.arange(to[-1]) + np.repeat(starts - to[:-1], ends - starts)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data[at])])


def distinct_units(texts: DataFrame) -> DataFrame:
    """(unit, freq) of the pre-tokens of a column of non-null texts, combined within slices: a unit may come once a slice. Both hashes tell
    units apart; those that share the first may come more than once."""

    def combined(batches):
        for b in batches:
            n_bytes = pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False)
            for first, last, data, starts, ends, doc in _pretokens(b.column(0)):
                real = n_bytes[first:last][doc] > 0
                starts, ends = starts[real], ends[real]
                h, v = _hashes(data, starts, ends), _second_hashes(data, starts, ends)
                order = np.argsort(h)
                h, v = h[order], v[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (v[1:] != v[:-1])))) if len(h) else np.zeros(0, int)
                one = order[new]
                yield pa.RecordBatch.from_arrays([_spans(data, starts[one], ends[one]), pa.array(np.diff(np.append(new, len(h))), pa.int64())], names=["unit", "freq"])

    return texts.mapInArrow(combined, "unit string, freq long")


def pretoken_counts(units: DataFrame, model: str = "piece_bpe_32k.model", hash_bits: int = 64) -> DataFrame:
    """Distinct (unit, freq) in, (u, v, freq, n_pieces) out; u and v are the pre-token's two 64-bit hashes."""

    def counted(batches):
        for b in batches:
            for first, last, data, offsets in tk.text_slices(b.column(0)):
                some = b.slice(first, last - first)
                hashes = [pa.array(_hashes(data, offsets[:-1], offsets[1:], hash_bits)), pa.array(_second_hashes(data, offsets[:-1], offsets[1:]))]
                yield pa.RecordBatch.from_arrays([*hashes, some.column(1), pa.array(_count(some.column(0).to_pylist(), model), pa.int64())], names=["u", "v", "freq", "n_pieces"])

    return units.mapInArrow(counted, "u long, v long, freq long, n_pieces long")


def _among(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in the sorted array, and whether it is there."""
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    return at, known[at] == h if len(known) else np.zeros(len(h), bool)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", limit: int = LIMIT, hash_bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row. Pre-tokens are told by a hash of ``hash_bits``; those that share theirs by a second one.

    A null or empty text has no bytes and no tokens. Rows are counted one by one, whatever their id: repeated
    rows and null ids too. An empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    units = distinct_units(base.select("text"))
    pieces = written(pretoken_counts(units.groupBy("unit").agg(F.sum("freq").alias("freq")), model, hash_bits))
    # Of 10^10 distinct pre-tokens about three pairs share a hash: these hashes are known to every task.
    shared = np.sort(pieces.groupBy("u").count().filter("count > 1").select("u").toArrow()["u"].to_numpy())
    if len(shared):
        twice = docs.sparkSession.createDataFrame(pa.table({"u": shared, "shared": np.ones(len(shared), bool)}))
        pieces = written(pieces.join(F.broadcast(twice), "u", "left").select(F.when(F.col("shared"), F.col("v")).otherwise(F.col("u")).alias("u"), "freq", "n_pieces"))
        if not pieces.groupBy("u").count().filter("count > 1").isEmpty():
            raise ValueError("two pre-tokens share both hashes")
    head = pieces.orderBy(F.desc("freq"), "u").limit(HEAD).select("u", "n_pieces").toArrow()
    order = np.argsort(head["u"].to_numpy())
    common = docs.sparkSession.sparkContext.broadcast((head["u"].to_numpy()[order], head["n_pieces"].to_numpy()[order], shared))

    def frequencies(batches):
        """For each row of the input one row with its id, bytes and the sum over common
        pre-tokens (u: a hash that no pre-token has), and one for each distinct rare pre-token."""
        known, pieces_of, shared = common.value
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            texts = b.column(1)
            n_bytes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last, data, starts, ends, doc in _pretokens(texts):
                n = last - first
                real = n_bytes[first:last][doc] > 0
                h, doc = _hashes(data, starts, ends, hash_bits)[real], doc[real]
                again = _among(shared, h)[1]
                if again.any():
                    h[again] = _second_hashes(data, starts[real][again], ends[real][again])
                at, hit = _among(known, h)
                sums = np.bincount(doc[hit], pieces_of[at[hit]], minlength=n).astype(np.int64)
                rare, owner = h[~hit], doc[~hit]
                order = np.lexsort((rare, owner))
                rare, owner = rare[order], owner[order]
                new = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1]))) if len(rare) else np.zeros(0, bool))
                freq = np.diff(np.append(new, len(rare)))
                rows = row + np.arange(n)
                row += n
                none = np.zeros(len(new), bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((rows, rows[owner[new]]))),
                    pa.array(np.concatenate((tk.mix(rows.astype(np.uint64)).view(np.int64), rare[new]))),
                    pa.array(np.concatenate((sums, freq))),
                    pa.array(np.concatenate((n_bytes[first:last], np.zeros(len(new), np.int64)))),
                    pa.concat_arrays([b.column(0).slice(first, n), pa.nulls(len(new), pa.int64())]),
                    pa.array(np.concatenate((np.ones(n, bool), none))),
                ], names=["key", "u", "n", "n_bytes", "doc_id", "whole"])

    counted = base.mapInArrow(frequencies, "key long, u long, n long, n_bytes long, doc_id long, whole boolean")
    counted = counted.join(pieces.select("u", "n_pieces"), "u", "left")
    known = F.coalesce("n_pieces", F.raise_error(F.lit("a pre-token was not counted")).cast("long"))
    value = F.col("n") * F.when(F.col("whole"), F.lit(1)).otherwise(known)
    sums = counted.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(value).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
