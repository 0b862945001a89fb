"""Joins, fingerprints, surrogates, pages, decontamination and the pipeline against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from placeworks.llm import components, decontamination, fingerprints, html_text, jaccard_join, surrogates
from placeworks.llm.store import table

LOWER = {k: k + 32 for k in range(65, 91)}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i if i is not None else -1, len(sets[k]), (i if i is not None else -1) if not sets[k] else least.get(find(k), -1)) for k, (i, _) in enumerate(rows))


def edited(words, rng, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        change = rng.random()
        if change < 0.6:
            w[k] = f"new{rng.randrange(10**6)}"
        elif change < 0.8:
            del w[k]
        else:
            w.insert(k, f"add{rng.randrange(10**6)}")
    return " ".join(w)


def near_copies(seed, n, length=60, edits=3, shared=0):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(length)]
    passage = [f"p{k}" for k in range(shared)]
    return [edited(base + passage, rng, rng.randrange(edits + 1)) for _ in range(n)]


def groups_of(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in df.collect())


def test_groups_of_odd_texts(frame, odd):
    rows = odd + [(8, "hello WORLD"), (9, "hello world again and again and"), (10, "a b c d"), (11, "a b c")]
    assert groups_of(jaccard_join.groups(frame(rows))) == brute_groups(rows)
    assert jaccard_join.groups(frame(rows).limit(0)).count() == 0


@pytest.mark.parametrize(("seed", "edits"), [(1, 2), (2, 4), (3, 7)])
def test_groups_of_near_copies(frame, seed, edits):
    """Groups larger than the count that makes a token hot, so both ways of finding links are used."""
    rng = random.Random(seed)
    texts = near_copies(seed, 60, edits=edits) + near_copies(seed + 50, 8) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 80))) + " " + " ".join(f"p{k}" for k in range(20)) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert groups_of(jaccard_join.groups(frame(rows))) == brute_groups(rows)


def test_groups_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert groups_of(jaccard_join.groups(docs)) == brute_groups(rows)


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["key"]: r["label"] for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}


def brute_versions(rows):
    """(doc_id, n_chars, edited text, text, next text) of each row, by falling id, null ids last; the order of rows of one id is theirs alone."""
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in rows), key=lambda r: r[:2], reverse=True)
    out = []
    for (known, i, text), (_, _, after) in zip(ordered, ordered[1:] + ordered[:1]):
        out.append((i if known else None, len(text), text[: len(text) - len(text) // 2] + after[: len(text) // 2], text, after))
    return out


def decoded(fingerprint, cells=fingerprints.CELLS):
    import base64

    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[cells * 8 : cells * 12], "<u4").astype(np.int32), np.frombuffer(raw[: cells * 8], "<u8"), np.frombuffer(raw[cells * 12 :], "<u4").astype(np.uint64)


def paragraphs(text):
    """Plain form of the cells of a text without a long line: its distinct lines, by their words."""
    return {x.strip(" \t\x0b\f\r") for x in text.split("\n")} - {""}


def check_versions(got, rows):
    want = brute_versions(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in got) == sorted((i is None, i or 0, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e, _, _ in want)
    by = {(r["doc_id"], r["edited_sha256"]): r for r in got}
    for i, _, changed, text, after in want:
        r = by[i, hashlib.sha256(changed.encode()).hexdigest()]
        for column, version in (("fingerprint", text), ("edited_fingerprint", changed)):
            keys, owner = fingerprints.digests([version])
            count, keyed, checked = fingerprints.sketch(keys, owner, 1, fingerprints.CELLS)
            assert all((a == b).all() for a, b in zip(decoded(r[column]), (count, keyed, checked)))
        if all(len(x.split()) <= fingerprints.LONG_WORDS for x in f"{text}\n{changed}\n{after}".split("\n")):
            a = paragraphs(text)
            for column, b in (("near_edited", paragraphs(changed)), ("near_next", paragraphs(after))):
                assert r[column] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0), (text, changed)


def test_versions(frame, odd):
    rows = [r for r in odd if r[0] != 4] + [(4, "Hello  world\n"), (20, "one two\nthree four\n" * 30), (21, "one two\nthree four\n" * 29 + "end"), (-(1 << 63), "the lowest id"), ((1 << 63) - 1, "the highest")]
    for parts in (1, 3, 9):
        check_versions(fingerprints.compare_versions(frame(rows).repartition(parts)).collect(), rows)
    one = fingerprints.compare_versions(frame([(1, "alone")])).collect()
    assert one[0]["near_next"] == 1.0
    assert fingerprints.compare_versions(frame(rows).limit(0)).count() == 0


def test_versions_of_repeated_ids(frame):
    """One id with many texts is split over ranges: each text is there once, and its next is another of them or what follows."""
    rows = [(k, f"text {k}\nand more") for k in range(20)] + [(10, f"other {k}\nof one id") for k in range(200)] + [(30, "same\nrow")] * 50
    ranged = fingerprints.with_next(frame(rows).repartition(8))
    assert ranged.filter("at = 10 and not ahead").select("range").distinct().count() > 3
    got = fingerprints.compare_versions(frame(rows).repartition(8)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    follows = lambda i: {t for k, t in rows if k == i} | {t for k, t in rows if k == max([x for x, _ in rows if x < i], default=30)}
    for r in got:
        own = {t for k, t in rows if k == r["doc_id"] and len(t) == r["n_chars"]}
        assert r["edited_sha256"] in {hashlib.sha256((t[: len(t) - len(t) // 2] + x[: len(t) // 2]).encode()).hexdigest() for t in own for x in follows(r["doc_id"])}


def test_versions_of_the_table(spark, sf_dir):
    from placeworks.llm.queries import op4_fingerprints

    check_versions(op4_fingerprints(spark, sf_dir).collect(), [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()])


def test_cells_are_paragraphs():
    """Lines are one cell each; only those of more than LONG_WORDS words are cut, at places that content alone decides."""
    words = [f"word{k}" for k in range(fingerprints.LONG_WORDS)]
    assert len(fingerprints.digests(["a b\n\n c d \na b"])[0]) == 2
    assert len(fingerprints.digests([" ".join(words)])[0]) == 1
    rng = random.Random(8)
    long = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    a, b = (set(fingerprints.digests([" ".join(x)])[0].tolist()) for x in (long, ["new", *long[3:]]))
    assert len(a) > 10 and len(a & b) >= len(a) - 2
    assert set(fingerprints.digests(["x\n" + " ".join(words) + "\ny"])[0].tolist()) > set(fingerprints.digests([" ".join(words)])[0].tolist())


def test_sketches_recover_differences():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 900))) for _ in range(30)]
    a = fingerprints.digests(texts)
    pairs = np.array([(i, j) for i in range(30) for j in range(30)])
    got = fingerprints.likeness(a, a, pairs)
    own = [set(a[0][a[1] == k].tolist()) for k in range(30)]
    for (i, j), x in zip(pairs, got):
        assert x == pytest.approx(len(own[i] & own[j]) / len(own[i] | own[j]))


def test_equal_texts_have_equal_fingerprints(frame):
    rows = fingerprints.fingerprint(frame([(1, "a b\nc"), (2, "a b\nc"), (3, "a b\nd"), (4, None), (5, "")])).collect()
    by = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert by[1] == by[2] != by[3] and by[4] == by[5]


PAGE = "<html><head><title>T</title></head><body><nav><a href=/x>menu</a></nav><div class='sidebar'>side</div>%s<footer>foot</footer></body></html>"


def test_pages(spark):
    article = "<article class='post-12'><header><h1>Head&amp;line</h1></header><p>One\n  two<br>three<p><b>Four &eacute; <i>five</i><ul><li>item</ul><aside>ad</aside><form>f</form><script>var t='</p>';</script><div class=comments>reader</div></article>"
    plain = "<div id=content><p>" + "long text " * 30 + "</p></div><div class=ad>buy</div>"
    rows = [(1, "https://www.a.example/1", PAGE % article), (2, "http://m.a.example:80/2?x", PAGE % article), (3, "a.example/3", PAGE % plain), (4, None, PAGE % plain), (5, "https://b.example", None), (6, "https://b.example", "no tags, &lt;but&gt; text"), (6, "https://b.example", "no tags, &lt;but&gt; text")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as path", "'z' as text")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()]
    by = {k: t for k, t, _ in got}
    assert len(got) == 7 and all(len(t) == n for _, t, n in got)
    assert by[1] == by[2] == "Head&line\nOne two three\nFour é five\nitem"
    assert by[3] == by[4] == ("long text " * 30).strip()
    assert by[5] == "" and by[6] == "no tags, <but> text"
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pages_of_the_table(spark, sf_dir):
    import html

    pages = table(spark, sf_dir, "pages")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        inside = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def naive_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    rng = random.Random(2)
    for _ in range(50):
        a, b = (np.array([rng.randrange(6) for _ in range(rng.randrange(1, 25))]) for _ in range(2))
        assert decontamination.align(a, b)[0] == naive_alignment(a, b)


def test_contamination(frame, spark, odd):
    rng = random.Random(3)
    items = [" ".join(f"{rng.choice('bcdfgh')}{rng.randrange(300)}x" for _ in range(30)) for _ in range(5)] + ["short one", None, ""]
    letters = lambda s: re.sub(r"\d", lambda m: "abcdefghij"[int(m.group())], s) if s else s
    items = [letters(x) for x in items]
    noise = lambda n: letters(" ".join(f"n{rng.randrange(900)}" for _ in range(n)))
    changed = items[1].split()
    for k in range(2, 30, 6):
        changed[k] = "other"
    del changed[10]
    rows = [(100, f"{noise(50)} {items[0].upper()}! {noise(50)}"), (101, f"{noise(20)} {' '.join(changed)} {noise(5)}"), (102, noise(300)), (103, f"{noise(9)} short, One {noise(9)}"), (104, items[2] + " " + items[3]), (105, " ".join(items[4].split()[:9]))]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "1 as score", "2 as doc_id")
    docs = frame(rows + odd)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == {(100, 0), (101, 1), (103, 5), (104, 2), (104, 3)}
    small = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark, block_bytes=200).collect()}
    assert small == got
    assert {r["doc_id"] for r in decontamination.keep_clean(docs, benchmark).collect()} == {102, 105} | {i for i, _ in odd}
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), benchmark).count() == 0


def test_contamination_of_the_table(spark, sf_dir):
    """The query over its whole tables against the alignment of every item with every document."""
    import pyarrow as pa

    from placeworks.llm import textkit as tk
    from placeworks.llm.queries import op2_decontamination

    def words(texts):
        (_, _, data, offsets), *_ = tk.text_slices(pa.array(texts, pa.string()), 1 << 40)
        h, doc, _, _ = decontamination.words_of(data, offsets)
        return [h[doc == k] for k in range(len(texts))]

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    items = table(spark, sf_dir, "benchmark").select("item_id", "text").collect()
    grams = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    item_words, want = words([r["text"] for r in items]), {}
    item_grams = [grams(w.tolist()) for w in item_words]
    for d, w in zip(docs, words([r["text"] for r in docs])):
        own = grams(w.tolist())
        for r, x, g in zip(items, item_words, item_grams):
            if own & g and (score := decontamination.align(x, w)[0] / (2 * len(x))) >= decontamination.THRESHOLD:
                want[d["doc_id"], r["item_id"]] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in op2_decontamination(spark, sf_dir).collect()}
    assert want and got == pytest.approx(want)


def test_seeds_are_counted_and_the_rarest_come_first(monkeypatch):
    import pyarrow as pa

    word = lambda k: "w" + "".join("abcdefghij"[int(c)] for c in str(k))
    item = [word(k) for k in range(12)]
    edited = [*item[:9], "x", "y", "z"]
    common, rare = " ".join(item[:3]), " ".join(item[3:])
    texts = [common] * 9 + [" ".join(edited) + " gap" * 40 + " " + " ".join(item), rare, " ".join(item[1:5]), None, ""]
    items = decontamination.Items([7, 8], [" ".join(item), "other words here"])
    column = pa.array(texts, pa.string())
    seeds, n = decontamination.counted(column, items)
    grams = collections.Counter(tuple(w[k : k + 3]) for w in (t.lower().split() for t in texts if t) for k in range(len(w) - 2))
    assert sorted(n.tolist()) == sorted(grams[tuple(item[k : k + 3])] for k in range(10))
    often = np.zeros(len(items.grams), np.int64)
    often[seeds] = n
    plain = sorted(decontamination.found_in(column, items, 0.5))
    calls = []
    align = decontamination.align
    monkeypatch.setattr(decontamination, "align", lambda a, b: calls.append(len(b)) or align(a, b))
    # The whole copy holds the rarest seeds; no other passage can beat it, so the edited one is not aligned.
    assert sorted(decontamination.found_in(column, items, 0.5, often)) == plain and len(calls) == 4
    assert [(r[0], r[1], r[2]) for r in plain] == [(9, 0, 1.0), (10, 0, 0.75)]
    assert [r[0] for r in decontamination.found_in(column, items, 0.5, often, any_item=True)] == [9, 10]
    # Of equal copies the first stays, whatever the order of visits.
    twice = pa.array([" ".join(item) + " gap" * 40 + " " + " ".join(item)])
    assert [r[3] for order in (often, often[::-1]) for r in decontamination.found_in(twice, items, 0.5, order)] == [0, 0]


def test_clean_documents_of_odd_tables(spark, frame, odd):
    item = " ".join(f"{c}ord" for c in "bcdfghjklmnp")
    rows = [*odd, (70, None), (71, f"x {item} y"), (71, f"x {item} y"), (72, ""), (72, "")]
    items = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "12 34")], "doc_id long, key string")
    kept = decontamination.keep_clean(frame(rows), items, item_col="doc_id", item_text_col="key")
    assert kept.columns == frame(rows).columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter(r for r in rows if r[0] != 71)
    assert decontamination.keep_clean(frame(rows), items, item_col="doc_id", item_text_col="key", block_bytes=40).count() == len(rows) - 2
    assert decontamination.keep_clean(frame(rows), items.limit(0), item_col="doc_id", item_text_col="key").count() == len(rows)
    assert decontamination.keep_clean(frame(rows).limit(0), items, item_col="doc_id", item_text_col="key").count() == 0


def test_surrogates(frame, odd):
    rows = odd + [
        (50, "Mail Ann.Lee@Mail.example.com or ann.lee@mail.example.com, call +1 (212) 555-0143 or (212) 555-0143."),
        (51, "Card 4111 1111 1111 1111 and 4111111111111111, ip 10.1.2.3, key 0123456789abcdef0123456789abcdef01234567"),
        (52, "Mrs. Smith met Anna Smith and Herr Müller; Mr. Jones stayed."),
        (53, "Nothing to see: 1.2 and 12:30, a@b, 2024-01-02."),
    ]
    out = surrogates.pseudonymise(frame(rows), "secret", found_col="found", chars_col="n")
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r)
    assert len(sum(got.values(), [])) == len(rows) and out.columns[:5] == frame(rows).columns
    for i, text in odd + rows[-1:]:
        assert text in [r["text"] for r in got[i]]
    (mail,), (card,), (names,) = got[50], got[51], got[52]
    found = mail["found"]
    assert "555-01" not in mail["text"] and "ann.lee" not in mail["text"].lower()
    assert len({v.lower() for k, v in found.items() if "@" in k}) == 1  # one address, whatever its case
    one, two = (v for k, v in found.items() if "212" in k)
    assert one.startswith("+1 (") and one.endswith(two) or two.startswith("+1 (") and two.endswith(one)
    cards = [v for k, v in card["found"].items() if k.startswith("4111")]
    assert cards[0].replace(" ", "") == cards[1].replace(" ", "") != "4111111111111111" and cards[0][0] == "4"
    digits = [int(c) for c in cards[0] if c.isdigit()]
    assert sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    assert re.search(r"key [0-9a-f]{40}$", card["text"])
    smith = {v.split()[-1] for k, v in names["found"].items() if k.endswith("Smith")}
    assert len(smith) == 1 and "Smith" not in names["text"]
    female = names["found"]["Anna Smith"].split()[0]
    assert female in surrogates.GIVEN["f", "latin"].split() and female != "Anna"
    assert len(set(names["found"].values())) == len(names["found"])
    again = surrogates.pseudonymise(frame(rows), "secret").filter("doc_id = 50").first()["text"]
    assert again == mail["text"] != surrogates.pseudonymise(frame(rows), "other").filter("doc_id = 50").first()["text"]


def test_surrogates_stay_distinct(spark):
    """Spaces that run out: ten units of one digit, which are all there are, and more given names than are listed."""
    units = spark.createDataFrame([("ip", f"1.2.3.{k}", "n", "latin") for k in range(200)] + [("given", f"name{k}", "f", "latin") for k in range(60)] + [("ssn", str(k), "n", "latin") for k in range(10)] + [("email", f"{c}@x.org", "n", "latin") for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, unit string, gender string, script string")
    rows = surrogates.distinct_surrogates(units, "k").collect()
    assert len(rows) == 296 and len({(r["kind"], r["surrogate"].lower()) for r in rows}) == 296
    real = {(r["kind"], r["unit"]) for r in rows}
    assert not any((r["kind"], r["surrogate"].lower()) in real for r in rows)
    form = {"ip": r"10(\.\d+){3}", "given": r"[A-Z][a-z]+", "ssn": r"\d\d+", "email": "[a-z]+"}
    assert all(re.fullmatch(form[r["kind"]], r["surrogate"]) for r in rows)


def test_longer_surrogates_keep_the_format(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("+1 (212) 555-0143", "9876543210", 10), ("123-45-6789", "98765432101", 9), ("12", "345", 2)], "raw string, new string, size int")
    assert [r[0] for r in rows.select(surrogates._filled(F.col("raw"), F.col("new"), F.col("size"), "0-9")).collect()] == ["+1 (987) 654-3210", "987-65-432101", "345"]


def test_surrogates_keep_forms(frame):
    """Each kind in its layouts: type, script, case, prefix and shared parts stay, and nothing of the original does."""
    rows = [
        (1, "Write to tom.fox@corp.org or eva@corp.org or TOM.FOX@CORP.ORG."),
        (2, "Mr John Paul van der Smith wrote; later Smith left, but Smithson stayed. MRS was not a name. Dr. SMITH too."),
        (3, "06 12 34 56 78 and +4915112345678 and +33 6 12 34 56 78 and 212-555-0143."),
        (4, "ghp_" + "aB3" * 40 + " and sk-proj-" + "xY9_" * 8 + " and " + "0a" * 100 + " end"),
        (5, "Bare 4111111111111111, not 4111111111111112; grouped 4111-1111-1111-1112."),
        (6, "Госпожа Анна Петрова и Иван Сидоров."),
        (7, "DE89 3704 0044 0532 0130 00 or DE89370400440532013000, 123-45-6789, 8.8.8.8"),
        (8, "12 34 56 78 90 and 2024-01-02 and 1 2 3 stay."),
    ]
    got = {r["doc_id"]: r for r in surrogates.pseudonymise(frame(rows), "k", found_col="found").collect()}
    found = got[1]["found"]
    domains = {v.lower().split("@")[1] for v in found.values()}
    assert len(found) == 3 and len(domains) == 1 and domains != {"corp.org"}
    assert found["TOM.FOX@CORP.ORG"] == found["tom.fox@corp.org"].upper() != found["eva@corp.org"].upper()
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{3}@.*", found["tom.fox@corp.org"])
    names = got[2]["text"]
    assert not re.search(r"John|Paul|\bSmith\b|SMITH", names) and "Smithson" in names and "MRS was not a name" in names
    whole, shouted = re.match(r"Mr (\w+) (\w+) van der (\w+) wrote; later (\w+) left", names), re.search(r"Dr\. ([A-Z]+) too", names)
    assert whole[3] == whole[4] and shouted[1] == whole[3].upper()
    assert len(got[3]["found"]) == 4 and re.fullmatch(r"\d\d \d\d \d\d \d\d \d\d and \+\d{13} and \+\d\d \d \d\d \d\d \d\d \d\d and \d{3}-\d{3}-\d{4}\.", got[3]["text"])
    assert re.fullmatch(r"ghp_([a-z][A-Z]\d){40} and sk-[a-z]{4}-([a-z][A-Z]\d_){8} and [0-9a-f]{200} end", got[4]["text"]) and "aB3aB3" not in got[4]["text"] and "0a0a0a" not in got[4]["text"]
    assert "4111111111111112" in got[5]["text"] and len(got[5]["found"]) == 2
    woman, man = re.fullmatch(r"Госпожа (\w+) (\w+) и (\w+) (\w+)\.", got[6]["text"]).group(1, 3)
    assert woman in surrogates.GIVEN["f", "cyrillic"].split() and man in surrogates.GIVEN["m", "cyrillic"].split() and man != "Иван"
    spaced, tight = re.match(r"(DE\d\d(?: \d{4}){4} \d\d) or (DE\d{20}), \d{3}-\d\d-\d{4}, 10\.", got[7]["text"]).groups()
    assert spaced.replace(" ", "") == tight
    assert got[8]["text"] == rows[7][1]


def test_words_that_are_surnames_stay_words(frame):
    """A bare surname is replaced where a person is meant; the same word stays where a thing is."""
    rows = [
        (1, "Mr White wore a White coat in the White House. Ms Rose has a Rose. Later White said no, and so did Rose. I asked White."),
        (2, "Mr Stone left. Stone walls are old. This Stone is grey; Stone's house was sold, and Stone laughed."),
        (3, "In 2021 300 4000 were sold, call 2021-300-4000 or +49 2021 300 4000."),
        (4, "Ingrid Svensson met Lars Holm. Svensson was late, Holm's car broke."),
        (5, "White paint, Rose gardens and Stone walls without a person."),
    ]
    out = {r["doc_id"]: (r["text"], r["found"]) for r in surrogates.pseudonymise(frame(rows), "k", found_col="found").collect()}
    white, rose = (out[1][1][k].split()[-1] for k in ("Mr White", "Ms Rose"))
    assert out[1][0] == f"Mr {white} wore a White coat in the White House. Ms {rose} has a Rose. Later {white} said no, and so did {rose}. I asked {white}."
    stone = out[2][1]["Mr Stone"].split()[-1]
    assert out[2][0] == f"Mr {stone} left. Stone walls are old. This Stone is grey; {stone}'s house was sold, and {stone} laughed."
    assert out[3][0].startswith("In 2021 300 4000 were sold, call ") and "2021-300-4000" not in out[3][0] and "2021 300 4000." not in out[3][0]
    assert "Svensson" not in out[4][0] and "Holm" not in out[4][0]
    assert out[5] == (rows[4][1], None)


def test_surrogates_of_the_table(spark, sf_dir):
    """The query over its whole table: texts are as a plain replacement of the mentions makes them, replacements are
    one to one, and nothing that simpler patterns know is left."""
    import regex

    from placeworks.llm.queries import op6_surrogates

    before = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    out = surrogates.pseudonymise(table(spark, sf_dir, "documents").selectExpr("*", "'x' as mentions", "'y' as text_hash", "'z' as replacements", "'s' as surnames"), "registered-query", found_col="found").collect()
    after = {r["doc_id"]: r["text"] for r in op6_surrogates(spark, sf_dir).collect()}
    assert len(out) == len(before) == len(after)
    pattern = regex.compile(surrogates.ENTITY)
    maps: dict[str, str] = {}
    for r in out:
        found = r["found"] or {}
        assert r["text"] == after[r["doc_id"]] == pattern.sub(lambda m: found.get(m[0], m[0]), before[r["doc_id"]])
        assert (r["mentions"], r["text_hash"], r["replacements"], r["surnames"]) == ("x", "y", "z", "s")
        for old, new in found.items():
            assert maps.setdefault(old, new) == new != old and [c.isdigit() for c in old if c.isalnum() or "@" in old][:1] == [c.isdigit() for c in new][:1] or "@" in old or "(" in old
    assert len(set(maps.values())) == len(maps) and not set(maps.values()) & set(maps)
    plain = regex.compile(r"\w[\w.]*@mail\d+\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b[0-9a-f]{40}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b")
    assert not {m for t in before.values() for m in plain.findall(t)} & {m for t in after.values() for m in plain.findall(t)}
    assert sum(before[i] != t for i, t in after.items()) < len(after) / 4


def test_surrogates_run_no_python(spark, sf_dir):
    from placeworks.llm.queries import op6_surrogates

    plan = op6_surrogates(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    quality = corpus_pipeline.good_quality(spark, docs, sf_dir)
    assert quality.columns == docs.columns
    kept = quality.collect()
    assert 0 < len(kept) < len(before)
    single = corpus_pipeline.one_of_each_group(spark, quality, sf_dir)
    rows = [(r["doc_id"], r["text"]) for r in kept]
    assert {r["doc_id"] for r in single.collect()} == {c for _, _, c in brute_groups(rows)}
    clean = corpus_pipeline.decontaminated(spark, single, sf_dir)
    items = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    assert clean.columns == docs.columns and not any(i in r["text"] for r in clean.collect() for i in items)
    private = corpus_pipeline.without_personal_data(spark, clean, sf_dir)
    assert private.columns == docs.columns and private.count() == clean.count()
    assert all(r["n_chars"] == len(r["text"]) for r in private.collect())
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in private.collect()}


def one_of_each(rows):
    """Brute force: rows (id, text) that stay. Groups are over distinct texts' sets; rows without words stay, equal rows with an id once."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    kept, first = [], {}
    for k, (i, t) in enumerate(rows):
        if sets[k]:
            first.setdefault(find(k), []).append((i is None, i or 0, t))
        elif i is None or (i, t) not in kept:
            kept.append((i, t))
    chosen = []
    for members in first.values():
        least = min(m[:2] for m in members)
        chosen.append((None if least[0] else least[1], {t for *head, t in members if tuple(head) == least}))
    return kept, chosen


def check_one_of_each(spark, frame, rows):
    kept = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, frame(rows), "").collect())
    plain, chosen = one_of_each(rows)
    for row in plain:
        kept[row] -= 1
    for i, texts in chosen:
        (mine,) = [(i, t) for t in texts if kept[i, t]][:1]
        kept[mine] -= 1
    assert not +kept and min(kept.values()) == 0


def test_one_of_each_group_of_odd_rows(spark, frame, odd):
    check_one_of_each(spark, frame, odd + [(8, "the of AND to is that was")])
    assert corpus_pipeline.one_of_each_group(spark, frame([(1, "a")]).limit(0), "").count() == 0


def test_one_of_each_group_of_repeated_ids(spark, frame):
    """A copy does not take another text of its id along."""
    other, more = "totally different words that nothing else has here", "and one more text of quite other words again"
    check_one_of_each(spark, frame, [(1, "a b c d e f g h"), (4, "a b c d e f g h"), (4, other), (5, more), (5, more), (6, other + " x y"), (None, "a b c d e f g h"), (None, more), (None, "alone without any id at all"), (None, "alone without any id at all")])


@pytest.mark.parametrize("max_keys", [1 << 20, 3])
def test_members_are_told_apart(spark, frame, max_keys):
    """By filter and, above the bound, by join; half of all rows are members."""
    from pyspark.sql import functions as F

    from placeworks.llm.membership import split
    from placeworks.llm.store import written

    docs = frame([(k, f"text {k % 700}") for k in range(2000)] + [(None, None)])
    keys = written(docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark")))
    inside, outside = split(docs, {"id": F.coalesce("doc_id", F.lit(-1)), "mark": F.xxhash64("text")}, keys, max_keys)
    assert inside.columns == outside.columns == docs.columns
    assert sorted(r["doc_id"] for r in inside.collect()) == list(range(0, 2000, 2))
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in outside.collect()) == [-1, *range(1, 2000, 2)]
    none, all_ = split(docs, {"id": F.coalesce("doc_id", F.lit(-1)), "mark": F.xxhash64("text")}, written(keys.limit(0)), max_keys)
    assert none.count() == 0 and all_.count() == 2001


def test_share_of_strangers_in_a_filter_does_not_grow(spark):
    from pyspark.sql import functions as F

    from placeworks.llm.membership import bloom, sift

    for n in (1000, 200_000):
        keys = spark.range(n).select(F.xxhash64("id").alias("h"))
        filter_ = spark.sparkContext.broadcast(bloom(keys, n))
        rows = spark.range(2 * n)
        passed = sift(rows, F.xxhash64("id"), filter_)
        assert passed.filter(f"id < {n}").count() == n and passed.count() <= 1.01 * n


def test_sets_of_one_key_are_told_apart(frame):
    rng = random.Random(11)
    texts = near_copies(1, 30, edits=3) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(20)) for _ in range(300)]
    rows = list(enumerate(texts + texts[:40]))
    assert groups_of(jaccard_join.groups(frame(rows), key_bits=6)) == brute_groups(rows)


@pytest.mark.parametrize("edits", [3, 7])
def test_all_links(frame, odd, edits):
    rng = random.Random(edits)
    texts = near_copies(edits, 60, edits=edits) + near_copies(edits + 9, 12) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(20)) + " " + " ".join(f"p{k}" for k in range(20)) for _ in range(30)]
    rows = odd + [(100 + k, t) for k, t in enumerate(texts + texts[:5])]
    pairs, members = jaccard_join.links(frame(rows))
    sets = [shingle_set(t) for _, t in rows]
    linked = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    want = sorted((i if i is not None else -1, sum(linked(a, b) for k, b in enumerate(sets) if k != j)) for j, ((i, _), a) in enumerate(zip(rows, sets)))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_links"]) for r in members.collect()) == want
    distinct = list({s for s in sets if s})
    assert pairs.count() == sum(linked(a, b) for k, a in enumerate(distinct) for b in distinct[:k])


def test_template_with_many_loose_members(frame):
    """5,000 texts that are mostly one template, each too far from it to link; some are near copies of each other."""
    rng = random.Random(12)
    template = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(5000):
        own = [f"o{rng.randrange(10**7)}" for _ in range(30)]
        rows.append((k, " ".join(template + own)))
        if k % 100 == 0:
            rows.append((10_000 + k, " ".join(template + own[:-1] + ["changed"])))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.groups(frame(rows).repartition(4)).collect()}
    assert got == {i: i - 10_000 if i >= 10_000 else i for i, _ in rows}


def test_other_stages_of_odd_tables(spark, sf_dir, odd):
    """Nulls in any column, repeated rows, columns of clashing names, and empty tables, in the stages that filter or rewrite."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, label string, score string, text_hash string, mentions string"
    rows = [(i, t, None, None, None if t is None else len(t), "l", None, "h", "m") for i, t in odd] + [(90, "Mail a.b@mail1.example.com now.", "en", "s", 31, None, "s", None, None)] * 2
    docs = spark.createDataFrame(rows, columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() <= len(rows), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    private = corpus_pipeline.without_personal_data(spark, docs, sf_dir).collect()
    assert len(private) == len(rows) and sum("mail1.example" in (r["text"] or "") for r in private) == 0
    assert len(corpus_pipeline.one_of_each_group(spark, docs, sf_dir).collect()) == len({(i, t) for i, t, *_ in rows})
    name, packed = corpus_pipeline.STAGES[-1]
    assert packed(spark, docs, sf_dir).select("doc_id").distinct().count() == len({r[0] for r in rows})
    assert packed(spark, docs.limit(0), sf_dir).count() == 0
