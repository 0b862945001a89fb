"""Ranked lexical search over an index in tiers, exact for every item.

The index holds every term of every row. It is made of segments, each of a few megabytes of text in the order of the
input, so building it shuffles nothing. A segment has a first row with its documents' ids and lengths, a row for each term, and a last row.
A term's postings are sorted by impact, the part of the score that hangs on the document only, and lie in three columns: the
highest sixteenth (eight postings at least), the rest of the highest quarter (64 at least), and all others. Beside them stand the
term's residual bounds: the highest impact in the tiers after the first and after the second.

A search reads the first tier of the terms that are asked for. A document's score lies between the sum of the impacts found and that sum
with the residual bound of each term not found; so does that of a document not found at all. An item is proven when no document whose score
is still open can reach its tenth best. Items without that proof fall through to the next tier; after the last one every score is known.
Scores are summed within segments and only the ten best of each item leave a task.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeworks.llm import textkit as tk
from placeworks.llm.store import scratch_dir, written

TOP, BLOCK_TERMS, SEGMENT_BYTES = 10, 1 << 17, 4 << 20
SHARES, LEAST = (16, 4), (8, 64)
TIERS = len(SHARES) + 1
HEAD, TERM, END = 0, 1, 2

_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True
_POSTING = np.dtype([("doc", "<u4"), ("tf", "<u4")])
_INDEX = "segment long, kind int, term string, n long, ids array<long>, lengths array<long>, bound1 long, bound2 long, tier0 binary, tier1 binary, tier2 binary"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a slice, lower-cased, and the document of each."""
    inside = _IN_TERM[data]
    starts, ends, doc = tk.spans(inside, offsets)
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(tk.lower_ascii(data[inside]))), doc


def _frequencies(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, then term, document and occurrences of each pair that occurs, by term and document, and the documents' lengths in terms."""
    words, doc = terms_of(data, offsets)
    n, coded = len(offsets) - 1, words.dictionary_encode()
    pairs, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + doc, return_counts=True)
    return coded.dictionary, pairs // n, pairs % n, tf, np.bincount(doc, minlength=n)


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """What an occurrence count adds to the score of a document of that length, before the term's weight."""
    m = 25 + (75 * length.astype(np.int64) * documents) // max(all_terms, 1)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


@dataclass(frozen=True)
class Index:
    """The rows of the index, the number of documents with a term, and that of all terms."""

    rows: DataFrame
    documents: int
    all_terms: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of every row of ``docs``; null texts have no terms. Equal ids are different documents."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def counted(batches):
        for b in batches:
            for _, _, data, offsets in tk.text_slices(b.column(0)):
                lengths = np.bincount(tk.spans(_IN_TERM[data], offsets)[2], minlength=len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([np.count_nonzero(lengths)], pa.int64()), pa.array([lengths.sum()], pa.int64())], names=["documents", "terms"])

    sums = base.select("text").mapInArrow(counted, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, all_terms = (x or 0 for x in sums)

    def indexed(batches):
        segment = TaskContext.get().partitionId() << 36
        for b in batches:
            for first, last, data, offsets in tk.text_slices(b.column(1), SEGMENT_BYTES):
                yield _segment(segment, b.column(0).slice(first, last - first), data, offsets, documents, all_terms)
                segment += 1

    return Index(written(base.mapInArrow(indexed, _INDEX)), documents, all_terms)


def _segment(segment: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, documents: int, all_terms: int) -> pa.RecordBatch:
    words, term, doc, tf, lengths = _frequencies(data, offsets)
    impact = impacts(tf, lengths[doc], documents, all_terms)
    count = np.bincount(term, minlength=len(words))
    begins = np.concatenate(([0], np.cumsum(count)))
    down = np.lexsort((-impact, term))
    rank = np.empty(len(term), np.int64)
    rank[down] = np.arange(len(term)) - begins[term]
    tier, bounds = np.zeros(len(term), np.int64), []
    for share, least in zip(SHARES, LEAST):
        kept = np.maximum(least, -(-count // share))
        tier += rank >= kept[term]
        more = count > kept
        bound = np.zeros(len(words), np.int64)
        bound[more] = impact[down][(begins[:-1] + kept)[more]]
        bounds.append(bound)
    order = np.argsort(term * TIERS + tier, kind="stable")
    postings = np.empty(len(term), _POSTING)
    postings["doc"], postings["tf"] = doc[order], tf[order]
    columns = []
    for k in range(TIERS):
        of = tier[order] == k
        at = np.concatenate(([0], np.cumsum(np.bincount(term[order][of], minlength=len(words))))) * _POSTING.itemsize
        columns.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(postings[of].tobytes())]).cast(pa.binary()))
    n, edge = len(words), lambda kind: pa.nulls(1, kind)
    around = lambda middle, kind: pa.concat_arrays([edge(kind), middle, edge(kind)])
    list_of = lambda x: pa.concat_arrays([pa.array([x], pa.list_(pa.int64())), pa.nulls(n + 1, pa.list_(pa.int64()))])
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n + 2, segment, np.int64)), pa.array(np.concatenate(([HEAD], np.full(n, TERM), [END])).astype(np.int32)),
        pa.concat_arrays([pa.array([""]), words.cast(pa.string()), pa.array([""])]), around(pa.array(count.astype(np.int64)), pa.int64()),
        pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.nulls(n + 1, pa.list_(pa.int64()))]), list_of(lengths),
        *[around(pa.array(x), pa.int64()) for x in bounds], *[around(x, pa.binary()) for x in columns],
    ], names=["segment", "kind", "term", "n", "ids", "lengths", "bound1", "bound2", "tier0", "tier1", "tier2"])


def _item_terms(batches):
    for b in batches:
        rows = b.column(0).to_numpy()
        for first, _, data, offsets in tk.text_slices(b.column(1)):
            words, term, item, n, _ = _frequencies(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(rows[first + item]), words.cast(pa.string()).take(pa.array(term)), pa.array(n.astype(np.int64))], names=["row", "term", "repeats"])


class _Best:
    """The best documents of one item so far: scores, ids, and which ids are null, in the order of the ranking."""

    def __init__(self, floor: int):
        self.score, self.id, self.null, self.floor, self.open = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), floor, -1

    def take(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray, top: int) -> None:
        least = max(1, self.floor, int(self.score[-1]) if len(self.score) == top else 0)
        at = np.flatnonzero(score >= least)
        if len(at) > top:
            at = at[score[at] >= np.partition(score[at], -top)[-top]]
        if len(at):
            score, ids, null = np.append(self.score, score[at]), np.append(self.id, ids[at]), np.append(self.null, null[at])
            order = np.lexsort((ids, null, -score))[:top]
            self.score, self.id, self.null = score[order], ids[order], null[order]


_FOUND = "row long, doc_id long, score long, open long, segment long"


def _scorer(asked, tiers: int, top: int, documents: int, all_terms: int):
    """Arrow function from rows of the index, those of a segment in one run, to the best documents of each item, the highest score that is
    open in an item, and the segments that the end of a task has cut. ``asked`` is a broadcast of rows, floors, borders, terms, weights and vocabulary."""

    def scored(batches):
        rows, floors, borders, term, weight, vocabulary = asked.value
        best = [_Best(f) for f in floors.tolist()]
        torn, held = [], []

        def end(whole: bool) -> None:
            if held and whole and held[0].column("kind")[0].as_py() == HEAD:
                _score(pa.Table.from_batches(held).combine_chunks(), tiers, top, documents, all_terms, best, borders, term, weight, vocabulary)
            elif held:
                torn.append(held[0].column("segment")[0].as_py())
            held.clear()

        for b in batches:
            segment, kind = b.column("segment").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(segment) else []
            for first, last in zip(cuts, [*cuts[1:], len(segment)]):
                if held and held[0].column("segment")[0].as_py() != segment[first]:
                    end(False)
                held.append(b.slice(first, last - first))
                if kind[last - 1] == END:
                    end(True)
        end(False)
        out = [(r, i if not z else None, s, None, None) for r, x in zip(rows.tolist(), best) for s, i, z in zip(x.score.tolist(), x.id.tolist(), x.null.tolist())]
        out += [(r, None, None, x.open, None) for r, x in zip(rows.tolist(), best) if x.open >= 0]
        out += [(None, None, None, None, s) for s in torn]
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "doc_id", "score", "open", "segment"])

    return scored


def _score(rows: pa.Table, tiers: int, top: int, documents: int, all_terms: int, best: list[_Best], borders, term, weight, vocabulary: pa.Array) -> None:
    """Scores the documents of one segment for every item."""
    flat = rows.column("ids")[0].values
    lengths, null = rows.column("lengths")[0].values.to_numpy(), flat.is_null().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(flat, 0).to_numpy()
    listed = rows.filter(pc.equal(rows.column("kind"), TERM)).combine_chunks()
    place = np.full(len(vocabulary), -1, np.int64)
    place[pc.index_in(listed.column("term"), vocabulary).to_numpy()] = np.arange(len(listed))
    postings, owner = [], []
    for k in range(tiers):
        lists = listed.column(f"tier{k}").combine_chunks() if len(listed) else pa.array([], pa.binary())
        postings.append(np.frombuffer(b"".join(lists.to_pylist()), _POSTING))
        owner.append(np.repeat(np.arange(len(lists)), pc.binary_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) // _POSTING.itemsize))
    postings, owner = np.concatenate(postings), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    doc, owner, tf = postings["doc"][order].astype(np.int64), owner[order], postings["tf"][order]
    impact = impacts(tf, lengths[doc], documents, all_terms)
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(listed)))))
    residual = listed.column(f"bound{tiers}").to_numpy() if tiers < TIERS and len(listed) else np.zeros(len(listed), np.int64)
    for k, item in enumerate(best):
        at = place[term[borders[k] : borders[k + 1]]]
        here = at >= 0
        at, w = at[here], weight[borders[k] : borders[k + 1]][here]
        if not len(at):
            continue
        low, missing = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for r, x, more in zip(at.tolist(), w.tolist(), residual[at].tolist()):
            of = slice(ends[r], ends[r + 1])
            low[doc[of]] += x * impact[of]
            if more:
                missing[doc[of]] -= x * more
        rest = int((w * residual[at]).sum())
        if rest:
            missing += rest
            unknown = missing > 0
            if unknown.any():
                item.open = max(item.open, int((low + missing)[unknown].max()))
        item.take(low, ids, null, top)


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score, tiers) of the ``top`` highest-scoring documents of each row of ``items``, scores above 0 only.

    Equal scores are ordered by ascending id, null ids last; rows of equal ids are documents of their own. ``tiers`` tells how many tiers the item's proof took. Items that are null,
    empty or without a known term have no rows; repeated items have theirs each. Items go in blocks of about
    ``block_terms`` terms, each of which is broadcast and passes over the terms it asks for.
    """
    spark = items.sparkSession
    asked = written(items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()))
    wanted = written(asked.select("row", "text").mapInArrow(_item_terms, "row long, term string, repeats long"))
    held = index.rows.filter(F.col("kind") == TERM).select("term", "n").join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    rarity = F.floor(1000 * F.log(F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = written(wanted.join(held.select("term", rarity.alias("w")).filter("w > 0"), "term").select("row", "term", (F.col("w") * F.col("repeats")).alias("weight")))
    blocks = -(-weighted.count() // block_terms)
    out = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame([], "row long, rank int, doc_id long, score long, tiers int").write.parquet(out)
    for block in range(blocks):
        rows = weighted.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).toArrow().to_pandas().sort_values(["row", "term"])
        floors = dict.fromkeys(rows["row"].tolist(), 0)
        for tiers in range(1, TIERS + 1):
            if floors:
                found = _round(index, rows, floors, tiers, top)
                rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
                best = written(found.filter("score is not null").withColumn("rank", rank).filter(F.col("rank") <= top).select("row", "rank", "doc_id", "score"))
                last = best.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least"))
                open_ = found.groupBy("row").agg(F.max("open").alias("open"))
                known = open_.join(last, "row", "left").toArrow().to_pandas()  # one row an item of the block
                known["least"] = known["least"].where(known["n"] == top, 0).fillna(0)
                proven = known[(known["open"].fillna(-1) < 0) | (known["open"] < known["least"])]["row"].tolist()
                floors = {r: max(floors[r], int(x)) for r, x in zip(known["row"].tolist(), known["least"].tolist()) if r not in set(proven)}
                if proven:
                    done = spark.createDataFrame(pa.table({"row": pa.array(proven, pa.int64())}))
                    best.join(F.broadcast(done), "row").select("row", F.col("rank").cast("int").alias("rank"), "doc_id", "score", F.lit(tiers).alias("tiers")).write.mode("append").parquet(out)
    ranked = spark.read.schema("row long, rank int, doc_id long, score long, tiers int").parquet(out)
    return ranked.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score", "tiers")


def _round(index: Index, rows, floors: dict[int, int], tiers: int, top: int) -> DataFrame:
    """What the first ``tiers`` tiers tell of the items in ``floors``: a row with a null id and score for each item, beside those of ``_scorer``."""
    spark = index.rows.sparkSession
    rows = rows[rows["row"].isin(set(floors))]
    names, term = np.unique(rows["term"].to_numpy(dtype=object), return_inverse=True)
    items, starts = np.unique(rows["row"].to_numpy(), return_index=True)
    vocabulary = pa.array(names.tolist(), pa.string())
    asked = spark.sparkContext.broadcast((items, np.array([floors[r] for r in items.tolist()], np.int64), np.append(starts, len(rows)), term, rows["weight"].to_numpy(), vocabulary))
    needed = ["segment", "kind", "term", "ids", "lengths", *[f"bound{tiers}"] * (tiers < TIERS), *[f"tier{k}" for k in range(tiers)]]
    terms = spark.createDataFrame(pa.table({"term": pa.concat_arrays([vocabulary, pa.array([""])])}))  # the first and last rows of segments have no term
    read = index.rows.select(*needed).join(F.broadcast(terms), "term", "left_semi")
    scorer = _scorer(asked, tiers, top, index.documents, index.all_terms)
    found = written(read.select(*needed).mapInArrow(scorer, _FOUND))
    torn = found.filter("segment is not null").select("segment").distinct()
    whole = found.filter("segment is null").drop("segment")
    if not torn.isEmpty():  # segments that lie across two tasks: few, dealt by segment
        again = read.select(*needed).join(torn, "segment", "left_semi").repartition("segment").sortWithinPartitions("segment", "kind")
        whole = whole.unionByName(written(again.select(*needed).mapInArrow(scorer, _FOUND)).drop("segment"))
    every = spark.createDataFrame(pa.table({"row": pa.array(items, pa.int64())}))
    return whole.unionByName(every.select("row", *[F.lit(None).cast("long").alias(c) for c in ("doc_id", "score", "open")]))


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The index of ``docs``, searched for ``items``."""
    return search(build(docs), items, top=top)
