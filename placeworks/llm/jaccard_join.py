"""Exact similarity join of word-shingle sets, and the groups that its links form.

Equal sets are one class, so copies never meet. Between classes, sets that link must share a
token among the first few of each in a common order of all tokens (prefix filter). The order
puts cold tokens first: a token is hot if its bucket in a sketch of counts over the whole corpus
stands out, so a cold token lies in a bounded number of sets.

* Cold tokens' index lists are short. Their entries are sorted by position and cut into blocks. Sets that share a token at
  positions p and q share at most min(p, q) before it and what is left after it: a pair
  of blocks whose positions leave too few to reach the threshold is skipped as a whole.
  Pairs that are left must share enough tokens of their prefixes.
* Hot tokens' lists have no bound, so no pairs are made of them. Each list has a pivot, the set
  with the fewest cold tokens; every member is compared with it. The answers of two members then
  follow from their differences to the pivot: |y ^ z| = |y ^ p| + |z ^ p| - 2 |(y ^ p) & (z ^ p)|. Members
  linked to the pivot are in one group already. Of the others, two that share no cold token (those that do were
  found above) can link only if the tokens they both lack, or hot ones they both add, suffice; few do, and only those are compared.

Links are verified on the whole texts. ``groups`` needs one link for each set first, then those between groups that are still apart;
``links`` verifies all. A class is told by a hash of its set; sets that share it without being equal are
found by a second hash and get others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeworks.llm import textkit as tk
from placeworks.llm.components import connected
from placeworks.llm.membership import MAX_KEYS, bloom, hits
from placeworks.llm.store import written

WORDS, PERCENT = 5, 80
#: The sketch of counts has a bucket for this many bytes of text, within limits: at the upper one a task's counts are 64 MB. A row is a block
#: of 2 KB, as Arrow batches hold up to ten thousand rows.
SKETCH_BYTES, MIN_BUCKETS, MAX_BUCKETS, BLOCK = 160, 1 << 18, 1 << 25, 1 << 10
#: Pairs that are made at once; loose members of a pivot that one task compares with the others.
PAIRS, LOOSE = 1 << 20, 1000
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending within it, and their documents.

    Words lie between ASCII white space and are lower-cased for A-Z. A document of fewer words is one shingle.
    """
    low = tk.lower_ascii(data)
    starts, ends, doc = tk.space_words(low, offsets)
    h = tk.span_hashes(low, starts, ends)
    grams, first = tk.gram_hashes(h, doc, words)
    owner = doc[first]
    count = np.bincount(doc, minlength=len(offsets) - 1)
    for n in range(1, words):
        if (count == n).any():
            few = count[doc] == n
            g, f = tk.gram_hashes(h[few], doc[few], n)
            grams, owner = np.concatenate((grams, g)), np.concatenate((owner, doc[few][f]))
    order = np.argsort(grams)
    order = order[np.argsort(owner[order].astype(np.int32), kind="stable")]
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[fresh], owner[fresh]


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (tokens >> _U(64 - buckets.bit_length() + 1)).astype(np.int64)


def overlap_needed(a, b, percent: int = PERCENT):
    """Fewest shared tokens of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


def hot_buckets(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Bitmap of the buckets that hold a token of many documents: those above the mean count by more than
    chance explains. Counts cover every token of every document. The sketch grows with the text, up to ``MAX_BUCKETS``; its blocks
    are summed in as many groups. A token that does not stand out is in about 12 sqrt(mean) sets at most."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << (size // SKETCH_BYTES).bit_length()))
    most = np.iinfo(np.uint16).max  # a task's counts stop there, far above any mean

    def counted(batches):
        counts = np.zeros(buckets, np.uint16)

        def add(tokens):
            at, n = np.unique(np.concatenate(tokens), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, most)

        waiting, size = [], 0
        for b in batches:
            for _, _, data, offsets in tk.text_slices(b.column(0)):
                waiting.append(_bucket(shingles(data, offsets, words)[0], buckets))
                size += len(waiting[-1])
                if size > 1 << 20:
                    add(waiting)
                    waiting, size = [], 0
        if waiting:
            add(waiting)
        blocks = counts.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(1))
        for k in np.array_split(some, -(-len(some) // 1024) or 1):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([row.tobytes() for row in blocks[k]], pa.binary())], names=["block", "counts"])

    def summed(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1)):
                new = np.frombuffer(counts.as_py(), np.uint16)
                sums[block] = sums[block] + new if block in sums else new.astype(np.uint32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([int(v.sum()) for v in sums.values()], pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "total", "counts"])

    sums = written(docs.select("text").mapInArrow(counted, "block long, counts binary").repartition("block").mapInArrow(summed, "block long, total long, counts binary"))
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / buckets
    above = mean + 6 * mean**0.5 + 8

    def flagged(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.packbits(np.frombuffer(c.as_py(), np.uint32) > above).tobytes() for c in b.column(1)], pa.binary())], names=["block", "bits"])

    rows = sums.select("block", "counts").mapInArrow(flagged, "block long, bits binary").toArrow()
    bitmap = np.zeros((buckets // BLOCK, BLOCK // 8), np.uint8)
    for block, bits in zip(rows["block"].to_pylist(), rows["bits"].to_pylist()):
        bitmap[block] = np.frombuffer(bits, np.uint8)
    return bitmap.ravel()


def _hot(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = _bucket(tokens, 8 * len(bitmap))
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1


class ClassKeys:
    """Keys of sets. ``clashing`` are keys that different sets were found to share: those sets take another, of their second hash."""

    def __init__(self, bits: int = 64, clashing: tuple = ()):
        self.mask, self.clashing = _U((1 << bits) - 1), np.array(sorted(clashing), np.int64).view(_U)

    def __call__(self, tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and second hash of each set, of sizes n, from all of its tokens; 0 for an empty one."""
        begin, full = np.concatenate(([0], np.cumsum(n)[:-1])), np.flatnonzero(n)
        key, check = np.zeros(len(n), _U), np.zeros(len(n), _U)
        if len(full):
            mixed, other = tk.mix(tokens), tk.mix(tokens ^ _U(0xA0761D6478BD642F))
            key[full] = (tk.mix(np.add.reduceat(mixed, begin[full]) + n[full].astype(_U)) ^ np.bitwise_xor.reduceat(mixed, begin[full])) & self.mask
            check[full] = tk.mix(np.add.reduceat(other, begin[full])) + n[full].astype(_U)
            if len(self.clashing):
                again = full[np.isin(key[full], self.clashing)]
                key[again] = tk.mix(check[again] ^ tk.mix(key[again]))
        return key, check


def prefixes(docs: DataFrame, bitmap, keys: ClassKeys, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, mark, key, check, n, cold, tokens): the hash of each document's text, the class of its set, its size, its prefix in the
    common order and how many of the prefix are cold. An empty set has a null key."""

    def made(batches):
        hot = bitmap.value
        for b in batches:
            for first, last, data, offsets in tk.text_slices(b.column(2)):
                tokens, owner = shingles(data, offsets, words)
                m = last - first
                n = np.bincount(owner, minlength=m)
                begin = np.concatenate(([0], np.cumsum(n)[:-1]))
                key, check = keys(tokens, n)
                is_hot = _hot(hot, tokens)
                order = np.argsort(owner.astype(np.int64) * 2 + is_hot, kind="stable")
                place = np.arange(len(tokens)) - begin[owner]
                taken = place < prefix_length(n, percent)[owner]
                ordered = tokens[order][taken]
                cold = np.bincount(owner[taken], 1 - is_hot[order][taken], minlength=m).astype(np.int32)
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner[taken], minlength=m))))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(first, m), b.column(1).slice(first, m), pa.array(key.view(np.int64), mask=n == 0), pa.array(check.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(cold),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ordered.view(np.int64))),
                ], names=["doc_id", "mark", "key", "check", "n", "cold", "tokens"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(made, "doc_id long, mark long, key long, check long, n long, cold int, tokens array<long>")


def _cold_pairs(percent: int):
    """Pairs (a, b, need) of sets in one cold token's list, b after a; rows come sorted by token."""

    def lists(batches):
        rest = None
        for b in batches:
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)]
            token = columns[0]
            if not len(token):
                continue
            cut = int(np.searchsorted(token == token[-1], True)) if (token == token[-1]).all() else int(np.flatnonzero(token != token[-1])[-1]) + 1
            rest = [c[cut:] for c in columns]
            if cut:
                yield [c[:cut] for c in columns]
        if rest is not None and len(rest[0]):
            yield rest

    def pairs(batches):
        for token, key, n, pos, cold in lists(batches):
            begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size = np.diff(np.append(begin, len(token)))
            prefix = prefix_length(n, percent)
            hot = np.maximum(prefix - cold, 0)
            left = n - pos  # tokens from this one on
            out, waiting = [], 0
            for length in np.unique(size[size > 1]):
                for i, j in _block_pairs(int(length), begin[size == length], pos, left, n, percent):
                    # within the block pairs that were not skipped: sizes and positions must leave enough
                    need = overlap_needed(n[i], n[j], percent)
                    fit = (np.minimum(pos[i], pos[j]) + np.minimum(left[i], left[j]) >= need) & (np.minimum(n[i], n[j]) >= need) & (key[i] != key[j])
                    i, j, need = i[fit], j[fit], need[fit]
                    shared = np.minimum(prefix[i] - n[i], prefix[j] - n[j]) + need - np.minimum(hot[i], hot[j])
                    out.append(np.stack([np.minimum(key[i], key[j]), np.maximum(key[i], key[j]), np.maximum(shared, 1)]))
                    waiting += len(i)
                    if waiting > PAIRS:
                        yield _pair_batch(out)
                        out, waiting = [], 0
            if waiting:
                yield _pair_batch(out)

    return pairs


def _pair_batch(parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(parts, 1)], names=["a", "b", "need"])


def _block_pairs(length: int, begins: np.ndarray, pos: np.ndarray, left: np.ndarray, n: np.ndarray, percent: int, width: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of the pairs of entries of lists of one length, about ``PAIRS`` at once. Entries are sorted by position, so a block of
    ``width`` has its last position, its most tokens left and its smallest set known: two blocks are skipped if even these cannot reach the overlap."""
    if length <= width:
        x, y = np.triu_indices(length, 1)
        for some in np.array_split(begins, -(-len(begins) * len(x) // PAIRS)):
            yield (some[:, None] + x).ravel(), (some[:, None] + y).ravel()
        return
    width = max(width, length // 64)
    blocks = [slice(k, min(k + width, length)) for k in range(0, length, width)]
    step = max(1, PAIRS // (length * width))
    for some in (begins[k : k + step] for k in range(0, len(begins), step)):
        entries = some[:, None] + np.arange(length)
        furthest = np.stack([pos[entries[:, s]].max(1) for s in blocks], 1)
        most = np.stack([left[entries[:, s]].max(1) for s in blocks], 1)
        least = np.stack([n[entries[:, s]].min(1) for s in blocks], 1)
        for p, bp in enumerate(blocks):
            out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for q in range(p, len(blocks)):
                kept = np.minimum(furthest[:, p], furthest[:, q]) + np.minimum(most[:, p], most[:, q]) >= overlap_needed(least[:, p], least[:, q], percent)
                if not kept.any():
                    continue
                rows = entries[kept]
                x, y = np.meshgrid(np.arange(length)[bp], np.arange(length)[blocks[q]], indexing="ij")
                upper = x.ravel() < y.ravel()
                out_i.append(rows[:, x.ravel()[upper]].ravel())
                out_j.append(rows[:, y.ravel()[upper]].ravel())
            yield np.concatenate(out_i), np.concatenate(out_j)


def _compare(pairs: DataFrame, texts: DataFrame, bitmap, words: int, percent: int) -> DataFrame:
    """(a, b, linked, n_a, apart, lack): whether the sets of keys a and b link, the size of a, |a ^ b|, and how
    much of that could be shared with another set without a cold token: what a lacks of b and hot ones it adds."""
    left = pairs.select("a", "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def sets(column):
        for first, last, data, offsets in tk.text_slices(column):
            tokens, owner = shingles(data, offsets, words)
            ends = np.searchsorted(owner, np.arange(last - first + 1))
            yield from (tokens[ends[k] : ends[k + 1]] for k in range(last - first))

    def compared(batches):
        hot = bitmap.value
        for batch in batches:
            rows = []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3))):
                added = x[~np.isin(x, y, assume_unique=True)] if len(x) and len(y) else x
                common = len(x) - len(added)
                missing = len(y) - common
                rows.append((100 * common >= percent * (len(y) + len(added)) and common > 0, len(x), len(added) + missing, missing + int(_hot(hot, added).sum())))
            linked, n, apart, lack = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(n, pa.int64()), pa.array(apart, pa.int64()), pa.array(lack, pa.int64())], names=["a", "b", "linked", "n_a", "apart", "lack"])

    return both.mapInArrow(compared, "a long, b long, linked boolean, n_a long, apart long, lack long")


def _texts(docs: DataFrame, wanted: DataFrame, classes: DataFrame, keys: ClassKeys, words: int) -> DataFrame:
    """(key, text) of one document of each wanted key. A Bloom filter of their ids and text hashes, as large as they are many, is broadcast, so
    few other texts are shuffled; of more than ``MAX_KEYS`` keys the texts are joined. Ids may be null or repeated, so the key of each text left is computed
    again, and texts are joined on that."""
    reps = written(wanted.join(classes, "key").select("key", F.xxhash64("rep.doc_id", "rep.mark").alias("at")))
    hashed, n_keys = docs.select("text", F.xxhash64("doc_id", F.xxhash64("text")).alias("at")), reps.count()
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom(reps.select("at"), n_keys)) if n_keys <= MAX_KEYS else None
    if filter_ is None:
        hashed = hashed.join(reps.select("at").distinct(), "at", "left_semi").select("text", "at")

    def keyed(batches):  # sifts too: a step of its own would be a second Python process for each task
        for b in batches:
            if filter_ is not None:
                b = b.filter(pa.array(hits(filter_.value, b.column(1).to_numpy())))
            for first, last, data, offsets in tk.text_slices(b.column(0)):
                tokens, owner = shingles(data, offsets, words)
                n = np.bincount(owner, minlength=last - first)
                key, at = np.unique(keys(tokens, n)[0].view(np.int64), return_index=True)
                key, at = key[n[at] > 0], at[n[at] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).slice(first, last - first).take(pa.array(at))], names=["key", "text"])

    found = hashed.mapInArrow(keyed, "key long, text string").join(reps.select("key"), "key", "left_semi")
    return written(found.groupBy("key").agg(F.first("text").alias("text")))


def _between_members(stars: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Pairs of members of one pivot, one of them not linked to it unless ``every``, whose differences to it may be close enough.

    Loose members of a pivot are dealt into groups of about ``LOOSE``, and those that may fit any of them go to each group."""
    rate = (100 - percent) / (100 + percent)
    m = stars.select("b", "a", "linked", F.col("n_a").alias("n"), "apart", (2 * F.col("lack") - F.col("apart")).alias("spare"))
    loose = m if every else m.filter(~F.col("linked"))
    # |y ^ z| >= |z ^ p| - spare of y; sets that link are within a factor of each other's size
    gap = F.col("apart") - F.col("n") * ((1 + 100 / percent) * rate)
    most = m.groupBy("b").agg(F.max("spare").alias("most"))
    z = loose.join(most, "b").filter(F.col("most") >= gap).drop("most")
    bounds = z.groupBy("b").agg(F.min(gap).alias("least"), F.ceil(F.count("*") / LOOSE).cast("int").alias("groups"))
    z = z.join(bounds.select("b", "groups"), "b").withColumn("deal", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int"))
    y = m.join(bounds, "b").filter(F.col("spare") >= F.col("least")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    z, y = z.alias("z"), y.alias("y")
    within = (F.col("y.n") + F.col("z.n")) * rate
    fit = (F.col("z.b") == F.col("y.b")) & (F.col("z.deal") == F.col("y.deal")) & (F.col("z.a") != F.col("y.a")) & (F.col("y.spare") >= F.col("z.apart") - within) & (F.col("z.spare") >= F.col("y.apart") - within)
    return z.join(y, fit).select(F.least("z.a", "y.a").alias("a"), F.greatest("z.a", "y.a").alias("b")).distinct()


class Candidates:
    """What is known of a corpus before links are verified: rows and classes, pairs that share enough cold tokens, pivots, texts."""

    def __init__(self, docs: DataFrame, words: int, percent: int, key_bits: int = 64):
        self.words, self.percent = words, percent
        self.bitmap = docs.sparkSession.sparkContext.broadcast(hot_buckets(docs, words))
        clashing: list[int] = []
        while True:
            keys = ClassKeys(key_bits, tuple(clashing))
            self.rows = written(prefixes(docs, self.bitmap, keys, words, percent))
            self.sets = self.rows.filter("key is not null")
            checks = [F.min(c).alias(f"least_{c}") for c in ("check", "n")] + [F.max(c).alias(f"most_{c}") for c in ("check", "n")]
            self.classes = written(self.sets.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "mark")).alias("rep"), F.count("*").alias("size"), *checks))
            # With 64 bits there are some tens of such keys among 5 * 10^10 sets, so they may come to the driver.
            more = [r["key"] for r in self.classes.filter("least_check != most_check or least_n != most_n").select("key").collect()]
            if not more:
                break
            clashing += more
        one = self.sets.groupBy("key").agg(F.first("n").alias("n"), F.first("cold").alias("cold"), F.first("tokens").alias("tokens"))
        entries = one.select("key", "n", "cold", F.posexplode(F.slice("tokens", 1, F.col("cold"))).alias("pos", "token")).select("token", "key", "n", "pos", "cold")
        lists = entries.repartition("token").sortWithinPartitions("token", "pos", "key")
        met = lists.mapInArrow(_cold_pairs(percent), "a long, b long, need long")
        self.near = written(met.groupBy("a", "b", "need").agg(F.count("*").alias("shared")).filter("shared >= need").select("a", "b"))

        hot = self.sets.filter(F.col("cold") < F.size("tokens")).select("key", "cold", F.explode(F.expr("slice(tokens, cold + 1, size(tokens))")).alias("token"))
        # A table of its own: it is small beside the members, so Spark broadcasts it or splits the members of a hot token.
        pivots = written(hot.groupBy("token").agg(F.min(F.struct("cold", "key"))["key"].alias("b")))
        self.stars = written(hot.join(pivots, "token").filter("key != b").select(F.col("key").alias("a"), "b").distinct())

        ends = [pairs.select(F.col(c).alias("key")) for pairs in (self.near, self.stars) for c in "ab"]
        self.texts = _texts(docs, ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).distinct(), self.classes, keys, words)

    def compare(self, pairs: DataFrame) -> DataFrame:
        return written(_compare(pairs, self.texts, self.bitmap, self.words, self.percent))


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, key_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_key, group_key, text_hash) of every row: the size of its set, the smallest id in its group,
    and keys of its class and group. ``key_bits`` is for tests.

    A null text, or one without words, has an empty set, is linked with nothing and is its own group, without keys. Null ids keep
    a null id; they link like others, and a group of null ids only has a null component. Repeated rows are one class and
    give a row each. An empty table gives no rows; other columns are ignored.
    """
    found = Candidates(_columns(docs, id_col, text_col), words, percent, key_bits)
    star_answers = found.compare(found.stars)
    first = found.near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first_answers = found.compare(first)
    links_ = star_answers.unionByName(first_answers).filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = written(connected(links_))

    label = lambda name: labels.select(F.col("key").alias(name), F.col("label").alias(f"label_{name}"))
    open_pairs = found.near.unionByName(_between_members(star_answers, percent)).distinct().join(label("a"), "a", "left").join(label("b"), "b", "left")
    open_pairs = open_pairs.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b").join(first, ["a", "b"], "left_anti")
    more = found.compare(open_pairs).filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not more.isEmpty():
        labels = written(connected(links_.unionByName(more)))

    of = found.classes.select("key", "doc_id").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = of.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = of.join(least, "label").select("key", "component_id", "label")
    rows = found.rows.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("mark").alias("text_hash")).join(of, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return rows.select("doc_id", "n_shingles", component, F.col("key").alias("class_key"), F.col("label").alias("group_key"), "text_hash")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): every link between two classes of different sets, as (a, b) of their keys, and
    (doc_id, class_key, n_links) of every row: how many other rows its text links with, its copies included.

    Unlike ``groups`` this verifies each pair, so it takes as long as there are links: a group of n different near copies has up to n^2 / 2.
    Copies are never expanded. Null texts and ones without words link with nothing; null ids and repeated rows are rows like others.
    """
    found = Candidates(_columns(docs, id_col, text_col), words, percent)
    star_answers = found.compare(found.stars)
    rest = found.near.unionByName(_between_members(star_answers, percent, every=True)).distinct()
    pairs = star_answers.unionByName(found.compare(rest)).filter("linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs)
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = found.classes.select("key", "size")
    around = ends.join(sizes.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("size").alias("around"))
    of = sizes.join(around, "key", "left").select("key", (F.coalesce("around", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    return pairs, found.rows.select("doc_id", "key").join(of, "key", "left").select("doc_id", F.col("key").alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
