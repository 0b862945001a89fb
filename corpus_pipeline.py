"""A training corpus from raw documents: each stage takes what its predecessor kept.

Stages filter or rewrite rows of ``documents`` and keep its columns; the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeworks.llm import decontamination, jaccard_join, packing, quality, surrogates
from placeworks.llm.membership import split
from placeworks.llm.queries import SURROGATE_KEY
from placeworks.llm.store import fold, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking does not reject. It learns from the labelled documents
    of the raw table, without those held out."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    return quality.keep_good(docs, quality.learn(table(spark, sf_dir, "documents"), labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id; of equal rows (id and text) one.

    A row is told by its id and its text, so other texts of a repeated id are not touched. Rows without an id count as near copies too and come last.
    Documents without words are linked with nothing and stay. Texts of rows that go are not shuffled.
    """
    groups = written(jaccard_join.groups(docs).select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("unknown"), "text_hash", "group_key"))
    row = {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "unknown": F.col("doc_id").isNull(), "text_hash": F.xxhash64("text")}
    first = groups.filter("group_key is not null").groupBy("group_key").agg(F.min(F.struct("unknown", "id", "text_hash")).alias("first"))
    others = groups.join(first, "group_key").filter(F.struct("unknown", "id", "text_hash") != F.col("first"))
    _, kept = split(docs, row, written(others.select(*row).distinct()))
    repeated = written(groups.filter("group_key is not null or not unknown").groupBy(*row).count().filter("count > 1").select(*row))
    if repeated.isEmpty():
        return kept
    twice, once = split(kept, row, repeated)
    return once.unionByName(twice.dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; the number of characters follows."""
    return surrogates.pseudonymise(docs, SURROGATE_KEY, chars_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near copies", one_of_each_group),
    ("decontamination", decontaminated),
    ("personal data", without_personal_data),
    ("packing", packed),
]
#: The stages have no form in SQL; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = written(docs)
    return docs
