"""Ranked search, mixing and fill-in-middle against SQL and plain versions, and odd inputs."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from placeworks.llm import fill_in_middle, mixing, queries, ranked_search
from placeworks.llm.store import table, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    result = con.execute(queries.ORACLE_SQL[name])
    order = [df.columns.index(d[0]) for d in result.description]
    assert sorted(df.columns) == sorted(d[0] for d in result.description)
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted((tuple(r[k] for k in order) for r in df.collect()), key=key) == sorted(result.fetchall(), key=key)


# ---- ranked search


def plain_ranking(docs, items, top=10):
    """Rows (item_id, rank, doc_id, score), every document scored for every item."""
    counts = [collections.Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    lengths = [sum(c.values()) for c in counts]
    n, all_ = sum(x > 0 for x in lengths), sum(lengths)
    df = collections.Counter(t for c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item_id, text in items:
        asked = TERM.findall((text or "").translate(LOWER))
        scores = []
        for (doc_id, _), c, length in zip(docs, counts, lengths):
            m = 25 + (75 * length * n) // max(all_, 1)
            scores.append((-sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c), doc_id is None, doc_id or 0))
        for k, (s, null, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:top]):
            out.append((item_id, k + 1, None if null else i, -s))
    return collections.Counter(out)


def ranking_of(df):
    return collections.Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def zipf_docs(seed, n, vocabulary=300):
    rng = random.Random(seed)
    word = lambda: f"w{int(vocabulary * rng.random() ** 3)}"
    return [(k, " ".join(word() for _ in range(rng.choice((3, 20, 60, 200))))) for k in range(n)], word


def test_ranking_of_odd_rows(spark, frame, odd):
    docs = odd + [(8, "HELLO world hello"), (9, "hello\x00world\x7fb"), (None, "Hello  world\n"), (10, "Ünder über")]
    items = [(1, "hello World b"), (1, "hello World b"), (2, None), (3, ""), (4, "?!"), (None, "der the 漢字"), (5, "unknown"), (6, "über über x")]
    asked = frame(items, ("item_id", "text"))
    assert ranking_of(ranked_search.rank(frame(docs), asked)) == plain_ranking(docs, items)
    assert ranked_search.rank(frame(docs).limit(0), asked).count() == 0
    assert ranked_search.rank(frame(docs), asked.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_over_tiers(spark, frame, monkeypatch, seed):
    """Small segments and short tiers, so that proofs happen in each tier; items in several blocks; a third of all rows are copies of one text."""
    monkeypatch.setattr(ranked_search, "SEGMENT_BYTES", 6000)
    monkeypatch.setattr(ranked_search, "LEAST", (2, 6))
    docs, word = zipf_docs(seed, 250)
    docs += [(1000 + k, docs[3][1]) for k in range(120)] + [(2000 + k, f"rare{k % 7} " + docs[k][1]) for k in range(60)]
    items = [(k, " ".join(word() for _ in range(1 + k % 9))) for k in range(25)] + [(100 + k, f"rare{k}") for k in range(7)] + [(200, docs[5][1])]
    rows = ranked_search.search(ranked_search.build(frame(docs)), frame(items, ("item_id", "text")), block_terms=40)
    assert ranking_of(rows) == plain_ranking(docs, items)
    took = {r["tiers"] for r in rows.select("tiers").distinct().collect()}
    assert len(took) > 1 and 1 in took


def test_segments_that_lie_across_tasks(spark, frame, monkeypatch):
    """An index whose files cut segments apart gives the same result."""
    monkeypatch.setattr(ranked_search, "SEGMENT_BYTES", 4000)
    docs, word = zipf_docs(5, 120)
    items = [(k, " ".join(word() for _ in range(5))) for k in range(8)]
    index = ranked_search.build(frame(docs))
    numbered = index.rows.coalesce(1).withColumn("at", F.monotonically_increasing_id())
    files = [written(numbered.filter(f"at % 100000 >= {a} and at % 100000 < {b}").drop("at").coalesce(1)) for a, b in ((0, 700), (700, 1500), (1500, 99999))]
    torn = ranked_search.Index(files[0].union(files[1]).union(files[2]), index.documents, index.all_terms)
    assert ranking_of(ranked_search.search(torn, frame(items, ("item_id", "text")))) == plain_ranking(docs, items)


def test_index_holds_every_posting(frame, monkeypatch):
    monkeypatch.setattr(ranked_search, "SEGMENT_BYTES", 5000)
    docs, _ = zipf_docs(7, 200)
    rows = ranked_search.build(frame(docs)).rows.collect()
    ids = {r["segment"]: r["ids"] for r in rows if r["kind"] == ranked_search.HEAD}
    got = collections.Counter()
    for r in rows:
        if r["kind"] == ranked_search.TERM:
            tiers = [np.frombuffer(r[f"tier{k}"], ranked_search._POSTING) for k in range(3)]
            assert sum(map(len, tiers)) == r["n"] and (len(tiers[1]) == 0 or len(tiers[0]) >= max(8, r["n"] // 16))
            got.update({(r["term"], ids[r["segment"]][d]): int(tf) for x in tiers for d, tf in x.tolist()})
    assert got == {(t, i): n for i, text in docs for t, n in collections.Counter(TERM.findall(text)).items()}


# ---- mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Exact shares, excess shared again until no source is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {s: float(x) for s, x in (fixed | share).items()}
        fixed |= {s: Fraction(most * sizes[s]) for s in over}


def check_mix(rows, docs):
    """docs: (doc_id, text, source). Sizes, targets and the taking of each source, by the drawn keys."""
    size = lambda t: len(WORD.findall(t or ""))
    assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == collections.Counter((i, s, size(t)) for i, t, s in docs)
    sizes = collections.Counter({s: 0 for _, _, s in docs})
    for _, t, s in docs:
        sizes[s] += size(t)
    targets = plain_targets(sizes)
    for s in sizes:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: r["sample_key"])
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s], rel=1e-12) for r in own)
        budget = round(targets[s])
        assert abs(sum(r["taken"] for r in own) - targets[s]) <= 0.5
        epochs = budget // sizes[s] if sizes[s] else 0
        assert {r["epochs"] for r in own} == {epochs}
        rest = budget - epochs * sizes[s]
        for k, r in enumerate(own):
            assert r["taken"] == epochs * r["size"] + r["part"] <= 3 * r["size"] and 0 <= r["part"] <= r["size"]
            if k and r["sample_key"] > own[k - 1]["sample_key"] and r["part"] > 0:  # those before it are taken whole
                assert own[k - 1]["part"] == own[k - 1]["size"]
        assert sum(r["part"] for r in own) == rest


def with_sources(spark, docs):
    return spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, source string, size string, place int")


def test_mix_of_the_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, sf_dir, "documents").collect()]
    rows = queries.op12_mixing(spark, sf_dir).collect()
    check_mix(rows, docs)
    assert sorted(rows) == sorted(queries.op12_mixing(spark, sf_dir).collect())
    scores = {r["doc_id"]: r["score"] for r in queries.quality.score(table(spark, sf_dir, "documents"), queries.quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))).collect()}
    assert all(abs(r["quality"] - scores[r["doc_id"]]) < 0.0011 for r in rows)


def test_mix_of_hot_and_odd_sources(spark, odd):
    rng = random.Random(3)
    docs = [(k, "word " * rng.randrange(1, 30), "hot" if k % 3 else f"s{k % 11}") for k in range(300)]
    docs += [(i, t, None) for i, t in odd] + [(900 + k, None, "only nulls") for k in range(3)] + [(990, "one", "tiny"), (991, "x " * 5000, "\U0001f600"), (992, "y", "￿"), (993, "z z", "")]
    check_mix(mixing.mix(with_sources(spark, docs)).collect(), docs)
    assert mixing.mix(with_sources(spark, docs[:1]).limit(0)).count() == 0
    assert [(r["target"], r["taken"]) for r in mixing.mix(with_sources(spark, [(1, None, "a"), (2, " ", None)])).collect()] == [(0.0, 0)] * 2


def test_better_documents_are_drawn_more_often(spark):
    docs = [(k, ("good " if k % 2 else "poor ") * 10, "a" if k < 2000 else "b") for k in range(4000)]
    weigh = lambda data, offsets: np.where(data[np.minimum(offsets[:-1], len(data) - 1)] == ord("g"), 1.0, 0.25)
    rows = [r for r in mixing.mix(with_sources(spark, docs), weigh, weights=(1, 3)).collect() if r["source"] == "a"]
    good, poor = (sum(r["part"] > 0 for r in rows if r["doc_id"] % 2 == k) for k in (1, 0))
    assert good + poor == 1000 and 2.2 < good / poor < 4.5  # half of all: good ones run out slowly, so the ratio is below 4


def test_texts_of_a_mix(spark):
    docs = [(k, f" a{k}  b{k}\nc{k} ", "s" if k < 20 else "t") for k in range(40)]
    frame = with_sources(spark, docs)
    mixed = written(mixing.mix(frame))
    rows = mixing.texts(frame, mixed).collect()
    taken = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    words = collections.Counter()
    for r in rows:
        assert docs[r["doc_id"]][1].split()[: len(r["text"].split())] == r["text"].split()
        words[r["doc_id"]] += len(r["text"].split())
    assert words == {i: n for i, n in taken.items() if n} and sum(words.values()) == 120


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), k, rng.randrange(100)) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, k int, n long").repartition(5)
    got = {(r["g"], r["k"]): r["before_n"] for r in mixing.running(df, [F.col("g"), F.col("k")], ["n"]).collect()}
    so_far = 0
    for g, k, n in sorted(rows):
        assert got[g, k] == so_far
        so_far += n


# ---- fill-in-middle


def plain_fim(doc_id, text, plain_share=10, spm_share=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain_share:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_share:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_odd_texts(frame, odd):
    rng = random.Random(9)
    signs = ["a", "Zz", "\x01", "\x02", "1", "2", "$0", "\\", "\r\n", "\n", "é", "é", "\U0001f600", "漢", "<", "P>", "S>", "<M", " ", " ", "\x85", "\x00"]
    rows = odd + [(100 + k, "".join(rng.choice(signs) for _ in range(rng.randrange(0, 25)))) for k in range(400)]
    rows += [(2000, "a<P>b"), (2001, "<S>"), (2002, "x<M>"), (2003, "\x02\x01\x021"), (2004, "\x01" * 50), (2005, "x" * 200_000), (2006, "a b " * 50_000)]
    made = fill_in_middle.transform(frame(rows))
    got = made.withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert collections.Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == collections.Counter(plain_fim(*r) for r in rows)
    assert all(r["again"] == r["text"] for r in got) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(frame(rows).limit(0)).count() == 0


def test_shares_of_forms(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    count = collections.Counter(r["form"] for r in fill_in_middle.transform(docs, plain_share=30, spm_share=50).collect())
    assert abs(count["plain"] / 4000 - 0.3) < 0.03 and abs(count["spm"] / 2800 - 0.5) < 0.04


def test_fill_in_middle_is_one_narrow_stage(spark, sf_dir):
    plan = queries.op13_fill_in_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
