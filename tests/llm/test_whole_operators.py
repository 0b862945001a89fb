"""Cases in which an operator must do the whole job."""

import random

from test_documents import brute_groups, groups_of

from placeworks.llm import decontamination, html_text, jaccard_join


def test_edited_copies_of_a_common_item(frame, spark):
    """An item that over 100 documents hold whole, and others with every fourth word replaced."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("bcdfghklm") for _ in range(n))
    item = [word(6) for _ in range(20)]
    edited = lambda: " ".join(word(7) if k % 4 == 1 else w for k, w in enumerate(item))
    rows = [(k, f"{word(5)} {' '.join(item)} {word(5)}") for k in range(110)] + [(k, f"{word(5)} {edited()} {word(5)}") for k in range(200, 350)] + [(k, edited()[:60]) for k in range(400, 410)]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontamination.contaminated(frame(rows), benchmark).collect()}
    assert got == {k: 1.0 if k < 200 else 0.625 for k, _ in rows if k < 400}


def test_copy_with_many_words_added(frame, spark):
    """The longest stretch that still scores: after half of the item as many words lie in between as it has."""
    item = [f"{a}{b}x" for a in "bcdfg" for b in "hklm"]
    text = " ".join(item[:10] + ["other"] * 20 + item[10:])
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    (row,) = decontamination.contaminated(frame([(1, text), (2, " ".join(item[:9]))]), benchmark).collect()
    assert (row["doc_id"], row["score"], row["passage"][-3:]) in [(1, 0.5, item[-1]), (1, 0.5, item[9])]


def test_articles_of_several_parts(spark):
    """Headline, lead and smaller sections around the container with most text; menus around it stay out."""
    body, part = "<p>" + "long text " * 60 + "</p>", "<p>" + "some text " * 12 + "</p>"
    links = "<div class=box>" + "<a href=/x>another page of the site</a> " * 9 + "</div>"
    lead = f"<h1>Head</h1><p>Lead.</p><div class=body>{body}</div>"
    pages = {
        "article": (f"<body>{links}<article>{lead}</article><div class=box>elsewhere</div></body>", ["Head", "Lead.", body]),
        "main": (f"<body>{links}<main><h1>Head</h1><article>{body}</article></main>{links}</body>", ["Head", body]),
        "sections": (f"<body><div class=text><div class=first>{body}</div><div class=second>{part}</div></div>{links}</body>", [body, part]),
        "bare": (f"<div class=first>{body}</div><div class=second>{part}</div>", [body, part]),
        "links": (f"<article>{links * 3}<div class=outer><h1>Head</h1><div class=inner>{body}</div></div></article>", ["Head", body]),
    }
    rows = [(k, f"https://{host}.example/{k}", page) for k, (host, (page, _)) in enumerate(pages.items())]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    clean = lambda x: x.replace("<p>", "").replace("</p>", "").strip()
    assert got == {k: "\n".join(map(clean, want)) for k, (_, want) in enumerate(pages.values())}


def test_nothing_of_an_article_is_dropped(spark):
    """Odd elements and class names inside the winning container; what the contract names is left out all the same."""
    long = "long text " * 40
    kept = {
        "<p class='related-work'>Work by others.</p>": "Work by others.",
        "<section class='search-results'><p>What the search gave.</p></section>": "What the search gave.",
        "<p>Where <math><mi>x</mi></math> is.</p>": "Where x is.",
        "<noscript><p>Plain form.</p></noscript>": "Plain form.",
        "<p>text <label>word</label> end</p>": "text word end",
        "<p>one <button>press</button> two</p>": "one two",
        "<p>a < b and 3 > 2 &lt;i&gt;</p>": "a < b and 3 > 2 <i>",
        "<fieldset><legend>Title</legend><p>Inside.</p></fieldset>": "Title\nInside.",
        "<div class=legal-history><p>Courts, see <a href=/x>this</a> and much more of it.</p></div>": "Courts, see this and much more of it.",
    }
    dropped = ["<div class=comments>reader</div>", "<div id='post-comments'><p>reader</p></div>", "<div class='related-posts'><a href=/a>another page</a> <a href=/b>and one more</a></div>", "<aside>side</aside>", "<form><label>name</label> send</form>", "<div class='ad-slot'>buy</div>", "<p class=notice>cookies</p>", "<svg><title>x</title></svg>"]
    rows = [(k, f"https://h{k}.example", f"<body><article><p>{long}</p>{piece}</article></body>") for k, piece in enumerate([*kept, *dropped])]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "\n".join([long.strip(), *x]) for k, x in enumerate([*([v] for v in kept.values()), *([] for _ in dropped)])}


def test_names_that_also_mean_something_else(spark):
    """Names whose words say more than boilerplate keep their element; names of nothing else lose it."""
    long = "long text " * 40
    kept = ["section class=market-share", "div class=social-science", "section id=sharing-economy", "section class=menu-prices", "section id=comment-on-law", "h2 class=header", "p class=more", "div class=alert", "div class=article-header", "div class=entry-content"]
    gone = ["div class=site-notice", "section class=reader-responses", "div class=article-comments", "div class='share-buttons'", "div id=ad-300x250", "div class=related-articles", "ul class=main-menu", "div class=newsletter-signup", "section class=post-replies", "div class=site-header"]
    rows = [(k, f"https://n{k}.example", f"<body><article><p>{long}</p><{x}>Some words here.</{x.split()[0]}></article></body>") for k, x in enumerate(kept + gone)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: long.strip() + ("\nSome words here." if k < len(kept) else "") for k in range(len(rows))}


def test_what_a_host_repeats_is_left_out(spark):
    """A box without a telling name goes where most differing pages of its host hold the same text in it; copies of a page count once,
    and a box at the same place with another text stays."""
    story = lambda k: f"<div class=col><p>{f'story {k} ' * 60}</p></div>"
    box = lambda text: f"<div class=extra><p>{text}</p></div>"
    rows = [(k, f"https://h.example/{k}", f"<body><article>{story(k)}{box('Call us any time, all days.')}</article></body>") for k in range(4)]
    rows += [(4, "https://h.example/4", f"<body><article>{story(4)}{box('A part of this story only.')}</article></body>")]
    rows += [(10 + k, "https://copies.example/", f"<body><article>{story(10)}{box('Part of the copied story.')}</article></body>") for k in range(5)]
    rows += [(20 + k, f"https://two.example/{k}", f"<body><article>{story(20 + k)}{box('Said on two pages only.')}</article></body>") for k in range(2)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), max_hosts=1).collect()}
    text = lambda k: f"story {k} " * 60
    want = {k: text(k).strip() for k in range(4)} | {4: text(4).strip() + "\nA part of this story only."}
    want |= {10 + k: text(10).strip() + "\nPart of the copied story." for k in range(5)} | {20 + k: text(20 + k).strip() + "\nSaid on two pages only." for k in range(2)}
    assert got == want


def test_broken_pages_take_linear_time():
    import time

    for page in ("<a href='x " * 10_000, '<a "' * 10_001 + ">", "<p>" + "<b" * 10_000, "<i '>" * 10_001, "<!" * 10_000, "<p class=" * 10_000):
        start = time.process_time()
        html_text.blocks(page)
        assert time.process_time() - start < 3, page[:12]


def test_long_page(spark):
    body = "".join(f"<p>Paragraph {k} of <b>many</b> &amp; more.</p>" for k in range(20_000))
    (row,) = html_text.extract(spark.createDataFrame([(1, "https://a.example", f"<body><nav>menu</nav><article>{body}</article></body>")], "page_id long, url string, html string")).collect()
    assert row["text"] == "\n".join(f"Paragraph {k} of many & more." for k in range(20_000)) and row["n_chars"] == len(row["text"])


def test_disputed_hosts_are_read_in_passes(spark):
    """Pages whose own best container is another one follow their host; with more disputed hosts than go into one broadcast too."""
    story, box = "<div class=story><p>" + "told here " * 30 + "</p></div>", "<div class=extra><p>" + "other things " * 60 + "</p></div>"
    short = "<div class=story><p>" + "told here " * 20 + "</p></div>"
    rows = []
    for h in range(5):
        rows += [(10 * h + k, f"https://www.h{h}.example/{k}", f"<body><a href=/>x</a>{story}</body>") for k in range(3)] + [(10 * h + 9, f"https://h{h}.example/9", f"<body>{'<a href=/>many links here</a> ' * 40}{short}{box}</body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = ({r["page_id"]: (r["text"], r["path"]) for r in html_text.extract(pages, max_hosts=n).collect()} for n in (100, 2))
    assert one == many and len(one) == 20 and {one[10 * h + 9][1] for h in range(5)} == {"/body/div.story"}


def test_groups_of_null_and_repeated_ids(frame):
    """Each id below stands for different texts; those of one id must not be taken for one another."""
    rng = random.Random(6)
    text = lambda: [f"v{rng.randrange(10**6)}" for _ in range(40)]
    one, two, three, four = text(), text(), text(), text()
    near = lambda words, n: " ".join([*words[:-n], *(f"end{n}x{k}" for k in range(n))])
    rows = [(None, near(one, 1)), (None, near(two, 1)), (1, near(one, 2)), (2, near(two, 3))]
    rows += [(7, near(three, 1)), (7, near(four, 1)), (3, near(three, 2)), (4, near(four, 3))]
    # shares a prefix token with the others but too little to link: it is compared, and must be with its own text
    rows += [(None, " ".join(one[:24] + text()[:12])), (7, " ".join(three[:24] + text()[:12]))]
    rows += [(None, " ".join(one[:31] + text()[:5])), (7, " ".join(three[:31] + text()[:5]))]
    assert groups_of(jaccard_join.groups(frame(rows))) == brute_groups(rows)


def test_texts_of_many_keys_are_joined(frame, monkeypatch):
    """Beyond the bound of the broadcast filter texts are joined; the groups are the same."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(50)]
    rows = [(k, " ".join(f"x{rng.randrange(999)}" if rng.random() < 0.02 else w for w in base)) for k in range(25)] + [(None, " ".join(base)), (30, None)]
    monkeypatch.setattr(jaccard_join, "MAX_KEYS", 0)
    assert groups_of(jaccard_join.groups(frame(rows))) == brute_groups(rows)


def test_recall_against_full_alignment():
    """Items found by seeds and bounds against the alignment of every item with every whole text: of the table, and of copies with a third of
    the words replaced at random, of which those without three words in a row of the item are not found."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from placeworks.llm import textkit as tk

    def full(text, items):
        out = set()
        for first, last, data, offsets in tk.text_slices(text):
            words, doc, _, _ = decontamination.words_of(data, offsets)
            bounds = np.searchsorted(doc, np.arange(len(offsets)))
            for k in range(last - first):
                w = words[bounds[k] : bounds[k + 1]]
                known = set(w.tolist())
                for j, target in enumerate(items.words):
                    # a score of a half needs half of the item's words
                    if len(w) and 2 * sum(x in known for x in target.tolist()) >= len(target) and decontamination.align(target, w)[0] >= len(target):
                        out.add((first + k, j))
        return out

    docs, benchmark = (pq.read_table(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = decontamination.Items(benchmark["item_id"].to_pylist(), benchmark["text"].to_pylist())
    found = lambda text: {(r[0], r[1]) for r in decontamination.found_in(text, items, decontamination.THRESHOLD)}
    text = docs["text"].combine_chunks()
    assert found(text) == full(text, items) != set()
    rng = random.Random(2)
    copies = [" ".join(w if rng.random() < 0.67 else f"new{rng.randrange(10**6)}" for w in t.split()) for t in benchmark["text"].to_pylist() for _ in range(10)]
    some = pa.array(copies)
    want = full(some, items)
    assert len(want) > 100 and len(found(some) & want) >= 0.9 * len(want)
