"""Held-out accuracy of the classifiers, and odd inputs."""

import re

import numpy as np

from placeworks.llm import language_id, quality, toxicity
from placeworks.llm.queries import op8_toxicity, op10_quality
from placeworks.llm.store import fold, table

LARGER, LARGEST = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def accuracy(spark, query, label):
    known = table(spark, LARGER, "labels")
    rows = query(spark, LARGER).join(known, "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    return np.mean([r[label] == r["predicted"] for r in rows])


def test_signs_that_are_no_letters(spark, frame, sf_dir):
    rows = [(1, "² ½ Ⅷ ① 12 _"), (2, "ªº"), (3, "² der Hund"), (4, "漢字")]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(frame(rows), language_id.learn(table(spark, sf_dir, "documents"))).collect()}
    assert got[1] == "und" and "und" not in (got[2], got[3], got[4])


def test_quality_held_out(spark):
    assert accuracy(spark, op10_quality, "quality") > 0.95


def test_toxicity_held_out(spark):
    assert accuracy(spark, op8_toxicity, "toxic") > 0.88


def test_quality_of_odd_texts(spark, sf_dir, frame, odd):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranking = quality.learn(docs, labels)
    rows = quality.score(frame(odd), ranking).collect()
    assert len(rows) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    kept = quality.keep_good(frame(odd), ranking)
    assert kept.columns == frame(odd).columns
    assert kept.count() == sum(r["predicted"] for r in rows)
    one_class = quality.learn(docs, labels.filter("quality = 1"))
    assert {r["predicted"] for r in quality.score(frame(odd), one_class).collect()} == {1}
    none = quality.learn(docs, labels.limit(0))
    assert quality.score(frame(odd).limit(0), none).count() == 0


def plain_features(text):
    """The features of one text, one word and one sign at a time."""
    space = " \t\n\x0b\f\r"
    words = [w for w in re.split(f"[{space}]+", text) if w]
    if not words:
        return np.zeros(len(quality.FEATURES))
    letter = lambda b: chr(b).isascii() and chr(b).isalpha() or b >= 128
    symbols = set(b"#$%&*+/<=>@\\^_`{|}~")
    n, raw = len(words), [w.encode() for w in words]
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    inner = [sum(map(letter, w)) for w in raw]
    marks = [sum(b in symbols for b in w) for w in raw]
    chars, lines = max(len(text), 1), [x for x in text.split("\n") if x]
    doubled = sum(len(w) > 2 and w[-1] == w[-2] and not letter(w[-1]) and not 48 <= w[-1] <= 57 for w in raw)
    return np.array([
        np.log1p(n), sum(inner) / n, sum(letter(b) and (b & 0xC0) != 0x80 for b in text.encode()) / chars, sum("A" <= c <= "Z" for c in text) / chars, sum("0" <= c <= "9" for c in text) / chars,
        np.tanh(8 * sum(b in symbols for b in text.encode()) / chars), np.tanh(8 * sum(i == 0 and m > 0 for i, m in zip(inner, marks)) / n), np.tanh(8 * sum(i > 0 and m > 1 for i, m in zip(inner, marks)) / n), np.tanh(8 * doubled / n),
        np.tanh(4 * sum(a == b for a, b in zip(low, low[1:])) / n), len(set(low)) / n, len(set(low)) / n**0.8, len(set(lines)) / max(len(lines), 1), np.tanh(4 * sum(w[-1:] in (b".", b"!", b"?") for w in raw) / n),
    ])


def test_quality_of_the_table(spark, sf_dir):
    """Every row of the query against features counted word by word."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    ranking = quality.learn(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = op10_quality(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert abs(ranking.score(plain_features(texts[r["doc_id"]])[None])[0] - r["score"]) < 1e-6


def test_quality_learns_from_all_labelled_documents_and_pairs(spark):
    """Means, weights, cut and width against Newton steps over every pair of a good and a poor labelled document, one by one."""
    labels = table(spark, LARGER, "labels").filter(fold("doc_id", 4) != 2)
    ranking = quality.learn(table(spark, LARGER, "documents"), labels)
    rows = table(spark, LARGER, "documents").join(labels, "doc_id").filter("text is not null and quality in (0, 1)").collect()
    x, good = np.array([plain_features(r["text"]) for r in rows]), np.array([r["quality"] == 1 for r in rows])
    assert np.allclose(ranking.mean, x.mean(0)) and np.allclose(ranking.scale, x.std(0), atol=2e-6)
    z = ranking.standard(x)
    d = (z[good][:, None] - z[~good][None]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(20):
        p = 1 / (1 + np.exp(-d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), d.T @ (1 - p) / len(d) - 1e-3 * w)
    assert abs(ranking.weights - w).max() < 3e-4
    s, k = np.sort(ranking.strength(x)), (~good).sum()
    assert np.isclose(ranking.cut, (s[k - 1] + s[k]) / 2)
    assert np.isclose(ranking.width, (np.median(ranking.strength(x[good])) - np.median(ranking.strength(x[~good]))) / 12)
    again = quality.learn(table(spark, LARGER, "documents").repartition(5, "text"), labels)
    assert (again.weights == ranking.weights).all() and np.isclose(again.cut, ranking.cut)  # whatever the order of rows


def test_features_of_labelled_documents_only(spark, sf_dir, monkeypatch):
    """Others are hardly measured, all labelled ones are, and the ranking is the same without a filter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = table(spark, sf_dir, "labels").filter("doc_id % 3 = 0").selectExpr("doc_id", "quality as label")
    ids = {r["doc_id"] for r in quality.measured(docs, known).collect()}
    expected = {r["doc_id"] for r in docs.join(known, "doc_id").collect()}
    assert expected <= ids and len(ids - expected) < 10
    ranking = quality.learn(docs, known, label_col="label")
    monkeypatch.setattr(quality, "MAX_KEYS", 0)
    assert len(quality.measured(docs, known).collect()) == docs.count()
    assert (quality.learn(docs, known, label_col="label").weights == ranking.weights).all()


def test_nth_value(spark):
    rng = np.random.default_rng(3)
    for values in ([1.0], [2.0] * 9, [0.0, 1e-300, 1e300, -1e300], [1.0] * 5 + [1.0 + 1e-15] * 4 + [7.0], rng.normal(size=3000).round(2), rng.standard_cauchy(3000)):
        found, s = spark.createDataFrame([(float(v),) for v in values], "s double").cache(), np.sort(values)
        for n in {1, 2, len(s) // 2, len(s) - 1, len(s)} & set(range(1, len(s) + 1)):
            assert quality.nth(found, n) == (s[n - 1], s[min(n, len(s) - 1)])


def test_quality_learns_from_odd_labels(spark, sf_dir, frame, odd):
    docs = frame(odd * 2)
    labels = spark.createDataFrame([(4, 1), (4, 0), (4, 1), (5, 1), (7, None), (None, 1), (99, 0)], "doc_id long, quality int").selectExpr("*", "'t' as text", "1 as label", "2 as x")
    ranking = quality.learn(docs, labels)
    assert {r["predicted"] for r in quality.score(docs, ranking).collect()} <= {0, 1}
    assert quality.keep_good(frame(odd).limit(0), ranking).count() == 0


def test_toxicity_of_odd_texts(spark, sf_dir, frame, odd):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.learn(docs, labels, dictionaries=language_id.learn(docs))
    rows = toxicity.score(frame(odd), net).collect()
    assert len(rows) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["language"] for r in rows if r["doc_id"] == 7} == {"de"} and {r["language"] for r in rows if r["doc_id"] == 1} == {"und"}
    one_class = toxicity.learn(docs, labels.filter("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score(frame(odd), one_class).collect()} == {0}
    assert toxicity.score(frame(odd).limit(0), net).count() == 0
    nothing = toxicity.learn(docs.limit(0), labels)
    assert {r["predicted"] for r in toxicity.score(frame(odd), nothing).collect()} == {0}
    # repeated rows, labels of both kinds for one text, null labels, and columns of the same names
    twice = docs.unionByName(docs).selectExpr("*", "'x' as label", "1 as toxic", "2 as total")
    again = labels.selectExpr("doc_id", "toxic", "'y' as text").unionByName(labels.selectExpr("doc_id", "1 - toxic as toxic", "'y' as text").limit(3)).unionByName(labels.selectExpr("doc_id", "cast(null as int) as toxic", "'z' as text"))
    assert toxicity.labelled_texts(twice, again, "doc_id", "text", "toxic", 10**6, 10**6).count() == labels.join(docs, "doc_id").filter("toxic is not null").count() + 3


def test_labelled_texts_are_bounded_by_size_not_by_length(spark, frame):
    rows = [(k, "word " * (10 if k else 40_000)) for k in range(20)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    assert toxicity.labelled_texts(frame(rows), labels, "doc_id", "text", "toxic", 100, 100).count() == 20
    assert toxicity.labelled_texts(frame(rows), labels, "doc_id", "text", "toxic", 100, 100, 300).count() == 6
    # one text that does not fit, wherever it comes in the order, leaves room for all others
    for long in range(20):
        rows = [(k, "word " * (400 if k == long else 5)) for k in range(20)]
        kept = toxicity.labelled_texts(frame(rows), labels, "doc_id", "text", "toxic", 100, 100, 1000).collect()
        assert {r["doc_id"] for r in kept} == set(range(20)) - {long}


def test_network_beats_log_odds_on_learnable_rows(spark):
    """What the network learns, from a random start: on a part of the learnable rows that it has not seen it ranks better than the
    largest log odds of a text's words, and far better than without training. The held-out rows have no part in this."""
    labels = table(spark, LARGEST, "labels").filter(fold("doc_id", 5) != 0)
    rows = table(spark, LARGEST, "documents").join(labels, "doc_id").select("doc_id", "text", "toxic").toPandas().sort_values("doc_id")
    order = np.random.default_rng(1).permutation(len(rows))
    some, rest = (rows.iloc[k] for k in np.split(order, [len(rows) * 4 // 5]))
    y, truth = some["toxic"].to_numpy(), rest["toxic"].to_numpy()

    def auc(s):
        rank = np.argsort(np.argsort(s, kind="stable"))
        return (rank[truth == 1].mean() - (truth.sum() - 1) / 2) / (truth == 0).sum()

    learned, unseen = toxicity.batched(some["text"].tolist(), y), toxicity.batched(rest["text"].tolist(), truth)
    seen = np.zeros((2, toxicity.BUCKETS))
    for t, label in learned:
        for k in (0, 1):
            mine = label[t.doc] == k
            seen[k] += np.bincount(np.unique((t.doc[mine, None] * toxicity.BUCKETS + t.parts[t.word[mine]]).ravel()) % toxicity.BUCKETS, minlength=toxicity.BUCKETS)
    odds = np.where(seen.sum(0) > 2, np.log((seen[1] + 0.5) / ((y == 1).sum() + 1)) - np.log((seen[0] + 0.5) / ((y == 0).sum() + 1)), 0)

    def largest(t):
        out = np.full(t.n_docs, -99.0)
        np.maximum.at(out, t.doc, odds[t.parts].sum(1)[t.word])
        return out

    logits = lambda net: np.concatenate([net.logits(t) for t, _ in unseen])
    fitted = toxicity.fit(some["text"].tolist(), y, (1.0, 1.0), {})
    baseline = auc(np.concatenate([largest(t) for t, _ in unseen]))
    assert auc(logits(fitted)) > baseline + 0.001
    assert auc(logits(toxicity.train(learned, (1.0, 1.0), epochs=0))) < 0.9


def test_scores_are_those_of_the_network_alone(spark, sf_dir):
    """Every row of the whole table against the network applied to one text at a time."""
    import pyarrow as pa

    from placeworks.llm import textkit as tk

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    dictionaries = language_id.learn(docs.filter(fold("doc_id", 5) != 0))
    net = toxicity.learn(docs, labels, dictionaries=dictionaries)
    coders = language_id.Coders(dictionaries)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = op8_toxicity(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        (_, _, data, offsets), *_ = tk.text_slices(pa.array([texts[r["doc_id"]]], pa.string()), 1 << 40)
        lang = coders.best(texts[r["doc_id"]])[0]
        assert abs(net.score(toxicity.tokens(data, offsets), [lang])[0] - r["score"]) < 1e-4 and r["language"] == lang
    by_language = {k: net.shift[k] for k in net.shift}
    assert "" in by_language and set(by_language) <= {"", "und", *dictionaries}


def test_maxima_are_those_of_a_plain_convolution():
    import pyarrow as pa

    from placeworks.llm import textkit as tk

    rng = np.random.default_rng(1)
    texts = ["alpha beta gamma alpha", "", "beta", "gamma delta"]
    (_, _, data, offsets), *_ = tk.text_slices(pa.array(texts))
    t = toxicity.tokens(data, offsets)
    net = toxicity.train([(t, np.array([1, 0, 0, 1]))], (1.0, 1.0), epochs=2)
    net.taps = rng.normal(size=net.taps.shape).astype(np.float32)
    pooled, _ = net.pooled(t)
    embedded = net.embedding[t.parts].sum(1)[t.word]
    for d in range(4):
        own = embedded[t.doc == d]
        column = 0
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for i in range(len(own) - width + 1):
                    a = net.bias[k * toxicity.FILTERS + f] + sum(own[i + j] @ net.taps[:, column + j * toxicity.FILTERS + f] for j in range(width))
                    best = max(best, a)
                assert abs(pooled[d, k * toxicity.FILTERS + f] - best) < 1e-3
            column += width * toxicity.FILTERS
