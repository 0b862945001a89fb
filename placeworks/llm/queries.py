"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeworks.llm import decontamination, fill_in_middle, fingerprints, html_text, jaccard_join, language_id, mixing, packing, quality, ranked_search, surrogates, token_counts, toxicity
from placeworks.llm.store import fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    found = language_id.identify(docs, language_id.learn(docs.filter(~held_out)))
    return found.withColumn("held_out", held_out)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_versions(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


#: Keys the surrogates; a deployment passes a secret of its own to the operator.
SURROGATE_KEY = "registered-query"


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = surrogates.pseudonymise(docs, SURROGATE_KEY, found_col="found")
    return found.select("doc_id", "text", F.coalesce(F.size("found"), F.lit(0)).alias("n_entities"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    dictionaries = language_id.learn(docs.filter(fold("doc_id", 5) != 0))  # thresholds are by language, told from the text alone
    net = toxicity.learn(docs, labels.filter(fold("doc_id", 5) != 0), dictionaries=dictionaries)
    return toxicity.score(docs, net).withColumn("held_out", fold("doc_id", 5) == 0)


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranking = quality.learn(docs, labels.filter(fold("doc_id", 4) != 2))
    return quality.score(docs, ranking).withColumn("held_out", fold("doc_id", 4) == 2)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.mix(docs, mixing.by_learned_quality(quality.learn(docs, labels)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_decontamination, op3_jaccard_join, op4_fingerprints, op5_token_counts, op6_surrogates, op7_packing, op8_toxicity, op9_page_text, op10_quality,
        op11_ranked_search, op12_mixing, op13_fill_in_middle,
    )
}
#: Methods without a form in SQL have none; tests/llm compares each such query with a brute-force version.
ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL
), totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term
), impacts AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)) AS impact FROM postings JOIN lengths USING (doc_id), totals
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    "op13_fill_in_middle": """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS s FROM documents
), units AS (
  SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM texts
), forms AS (
  SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units
), parts AS (
  SELECT doc_id, n, form, t, CASE WHEN form <> 'plain' THEN array_to_string(u[1:a], '') END AS p,
    CASE WHEN form <> 'plain' THEN array_to_string(u[a + 1:b], '') END AS m, CASE WHEN form <> 'plain' THEN array_to_string(u[b + 1:n], '') END AS e FROM forms)
SELECT doc_id, n, form, length(p)::BIGINT AS prefix_chars, length(m)::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
""",
}
