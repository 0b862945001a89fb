"""Language identification by compression: a text belongs to the language whose dictionary
compresses it best.

Each language's raw-content zstandard dictionary is made of one piece of each of a bounded sample of its
labelled documents (``DOCS_PER_LANGUAGE``, ``DICTIONARY_BYTES``), cut in Spark from anywhere in the text, however long that is.
Whole texts are scored, in blocks, so that the dictionary stays in the window of every part of a long text. A block is compressed
behind a piece of the dictionary, which costs next to nothing and is subtracted: alone a short one
would be stored as it is, equally large for all languages. One rule holds for all lengths. Scores follow from the sizes;
where the best two are close the prediction is marked as not accepted.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DOCS_PER_LANGUAGE, DICTIONARY_BYTES, BLOCK_BYTES, CONTEXT_BYTES, LEVEL, MIN_MARGIN = 400, 96 << 10, 4096, 256, 6, 0.02
UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"\P{L}+")


def normalised(text: str | None) -> bytes:
    """Lower-case words of letters, single spaces around each; empty if there is no letter."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {words} ".encode("utf-8", "replace") if words else b""


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, from at most ``docs_per_language`` documents of each, those of the smallest id hash.

    A piece of a document starts at a place that the hash of its text says; pieces of one language are equally long,
    so together they are about ``dictionary_bytes``. Only pieces reach the driver. Rows with a null language or
    text are passed over. The order is by falling number of documents: ties go to the first. An empty table teaches nothing.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = F.xxhash64(F.col(id_col).cast("string"))
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col)).count().collect()}
    by_lang = lambda of, other: F.coalesce(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, of(n))])[F.col(lang_col)], F.lit(other)) if counts else F.lit(other)
    # Keep the hashes below each language's share of the hash range: a filter, so no language is gathered in one task.
    share = by_lang(lambda n: min(1.0, 2 * docs_per_language / n), 0.0)
    length = by_lang(lambda n: -(-dictionary_bytes // min(n, docs_per_language)), 1)
    begin = F.pmod(F.xxhash64(text_col), F.greatest(F.length(text_col) - length, F.lit(0)) + 1) + 1
    near = labelled.filter((F.pmod(order, F.lit(1 << 20)) / F.lit(1 << 20)) < share)
    pieces = near.select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col), begin.cast("int"), length).alias("piece"), order.alias("at"))
    picked = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("at", "piece"))).filter(F.col("nth") <= docs_per_language).orderBy("lang", "nth")
    found: dict[str, list[bytes]] = {}
    for r in picked.collect():
        found.setdefault(r["lang"], []).append(normalised(r["piece"]))
    joined = {lang: b"".join(found[lang])[-dictionary_bytes:] for lang in sorted(found, key=lambda k: (-counts.get(k, 0), k))}
    return {lang: data for lang, data in joined.items() if data}


class Coders:
    """Compressors with the dictionaries of some languages; made where they are used, as they cannot be sent."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.langs, self.coders = list(dictionaries), []
        for content in dictionaries.values():
            dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            coder = z.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            context = content[-CONTEXT_BYTES:]
            self.coders.append((coder, context, len(coder.compress(context))))

    def sizes(self, data: bytes) -> list[int]:
        """Compressed size of normalised text under each language."""
        blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
        return [sum(max(1, len(coder.compress(context + b)) - alone) for b in blocks) for coder, context, alone in self.coders]

    def best(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin of a text."""
        data = normalised(text)
        if not data or not self.langs:
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(data)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        least = sizes[order[0]]
        margin = (sizes[order[1]] - least) / least if len(order) > 1 else 1.0
        return self.langs[order[0]], 1 / sum(math.exp(max(least - s, -700)) for s in sizes), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, margin, accepted) of every row.

    ``lang_pred`` is the language of the smallest size, ``und`` for a null text, one without letters, or
    if nothing was learned. ``margin`` is how much larger the second size is, as a share; ``accepted`` is
    false below ``min_margin``: callers that want a rejecting classifier use it. Repeated rows
    give repeated results, an empty table none; other columns are ignored.
    """
    def predicted(batches):
        coders = Coders(dictionaries)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                lang, score, margin = coders.best(text.as_py())
                rows.append((lang, score, margin, lang != UNKNOWN and margin >= min_margin))
            lang, score, margin, accepted = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "margin", "accepted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(predicted, "doc_id long, lang_pred string, score double, margin double, accepted boolean")
