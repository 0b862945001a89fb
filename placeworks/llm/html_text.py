"""Main text of web pages by consensus of a host's pages.

Each page's containers are scored by the text their blocks hold, and the page votes for
the generalised path (tags with classes, digits dropped) of its best container. Votes are summed by host in Spark,
with map-side combining, so a host of any size is a few rows per task; only hosts whose pages disagree matter then. Pages are read again and
the text below the host's winning path is taken, widened to what lies around it unless that is mostly links, so
headlines, lead paragraphs and smaller sections stay; a page without that path falls back to its own best container.

Within it the names of elements decide only where they say nothing else: "site-notice" is boilerplate, "market-share" and a lone
"alert" may be. What may be, and what has no telling name, goes if it is mostly links, or if the host repeats it: the texts of containers
inside the main one are counted by host and path over pages that differ, and a text that most of these pages hold is left out of all of them.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeworks.llm.store import written

#: Hosts whose rules are broadcast at once, and their bytes.
MAX_HOSTS, MAX_BYTES = 1 << 20, 1 << 27

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>", re.S)
#: A tag with a quote that is never closed ends at the next bracket.
_BROKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")

#: Elements of HTML by what they mean here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template textarea title iframe svg noembed noframes".split())
_CONTROL = frozenset("button select datalist".split())
_LEFT_OUT = frozenset("nav footer aside form menu dialog head header".split())
_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption hr div section article main body address details summary center html fieldset legend".split())
_CONTAINER = frozenset("div section article main body td".split())
_CLOSED_BY = {"p": _BLOCK - {"body", "html"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: Words of class names, ids and roles that mark boilerplate. The first ones and ``_TELLING`` do so if all other words of the name are of these or
#: ``_NEUTRAL``; a name of ``_UNSURE`` words needs one that speaks of the site, or to stand alone. Any other name with such a word only makes an element suspect: "market-share" and
#: "related-work" may be parts of an article.
_SURE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments disqus cookie cookies consent gdpr popup modal newsletter subscribe signup share sharing social pagination pager".split())
_UNSURE = frozenset("banner header alert overlay related recommended legal hidden more skip search side".split())
_TELLING = frozenset("respond response responses reply replies notice notices widget widgets toolbar copyright disclaimer login".split())
_NEUTRAL = frozenset("site page post posts reader readers user users box block slot list item items area section wrap wrapper container inner outer top bottom left right main global bar links link form buttons button icons icon menu text title label content module unit zone panel row col column widget thread count feed sm md lg xs xl js is has fixed sticky mobile desktop primary secondary the".split())
_ABOUT = frozenset("article articles entry story stories news blog wp fb facebook twitter google x".split())
_OF_SITE = frozenset("site global posts articles stories links pages".split())
_UNSURE_ALONE = frozenset("banner overlay related recommended skip search".split())
#: Text elements are left out by name only if it is one of the sure words.
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote pre figcaption".split())
REPEATED_ON = 3
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


class _Node:
    __slots__ = ("label", "out", "parent", "path", "suspect", "tag")

    def __init__(self, tag, label, path, parent, out, suspect=False):
        self.tag, self.label, self.path, self.parent, self.out, self.suspect = tag, label, path, parent, out, suspect


def _label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Tag with its classes, digits dropped, whether its names mark it as boilerplate, and whether they may."""
    if "=" not in attributes:
        return tag, False, False
    values = {}
    for name, a, b, c in _NAMES.findall(attributes):
        values.setdefault(name.lower(), a or b or c)
    classes = sorted({re.sub(r"\d+", "", x) for x in values.get("class", "").lower().split()} - {""})
    label = ".".join([tag, *classes])
    if tag in ("html", "body", "article", "main"):
        return label, False, False
    marked, suspect = values.get("role", "").lower() in _ROLES, False
    for name in f"{values.get('class', '')} {values.get('id', '')}".lower().split():
        words = [w for w in re.split(r"[_-]+|\d+", name) if w]
        if not words:
            continue
        known = [w for w in words if w in _SURE or w in _TELLING]
        rest = [w for w in words if w not in _SURE and w not in _TELLING]
        unsure = [w for w in rest if w in _UNSURE]
        if known and all(w in _NEUTRAL or w in _UNSURE or w in _ABOUT for w in rest):
            marked = True
        elif unsure and tag not in _TEXT_TAGS and (len(words) == 1 and words[0] in _UNSURE_ALONE or len(words) > 1 and all(w in _OF_SITE or w in _UNSURE for w in words)):
            marked = True
        elif known or unsure:
            suspect = True
    return label, marked, suspect


def blocks(page: str) -> list[tuple[_Node, str, int]]:
    """(innermost container, text, characters in links) of each block of text, in page order; what lies
    in left-out elements is not there, nor what lies in one whose names may mark it and whose text is mostly links.
    Inside an article or main element a header keeps its headings and text. Form controls are left out without ending a block."""
    root = _Node("", "", "", None, False)
    top, out = root, []
    text: list[str] = []
    links = [0, 0]  # characters in links; depth of links
    suspects: dict[_Node, list[int]] = {}  # characters and those in links of elements that may be boilerplate

    def end_block():
        if text:
            whole = _SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if whole and not top.out:
                linked = min(links[0], len(whole))
                node = top
                while node:
                    if node.suspect:
                        size = suspects.setdefault(node, [0, 0])
                        size[0] += len(whole)
                        size[1] += linked
                    node = node.parent
                node = top
                while node.tag not in _CONTAINER and node.parent:
                    node = node.parent
                out.append((node, top, whole, linked))
        links[0] = 0

    def add(piece, raw=False):
        if piece and not top.out:
            piece = piece if raw else html.unescape(piece)
            text.append(piece)
            if links[1]:
                links[0] += len(piece.strip())

    at, n, last = 0, len(page), page.rfind(">")
    low = None
    while at < n:
        less = page.find("<", at)
        if less > last and not page.startswith("<!--", less):  # no tag ends from here on
            less = page.find("<!--", at)
        add(page[at : less if less >= 0 else n])
        if less < 0:
            break
        m = _TOKEN.match(page, less)
        shift = 0
        if not m:
            m, shift = _BROKEN.match(page, less), 1
        if not m:  # a sign, not a tag
            add("<")
            at = less + 1
            continue
        at = m.end()
        closing, tag, attributes = m[2 - shift], m[3 - shift], m[4 - shift]
        if tag is None:
            if m[1] is not None:
                add(m[1], raw=True)
            continue
        tag = tag.lower()
        if closing:
            if tag == "a" and links[1]:
                links[1] -= 1
            node = top
            while node.parent and node.tag != tag:
                node = node.parent
            if node.parent:
                if tag in _BLOCK or tag in _LEFT_OUT:
                    end_block()
                top = node.parent
            elif tag == "p":
                end_block()
            continue
        if tag in _VOID:
            if tag == "hr":
                end_block()
            elif tag == "br":
                add(" ", raw=True)
            continue
        if tag in _RAW or tag in _CONTROL:
            low = low if low is not None else page.lower()
            close = low.find(f"</{tag}", at)
            stop = low.find(">", close) + 1 if close >= 0 else n
            at = stop if stop > 0 else n
            continue
        if tag == "a":
            links[1] += 1
        if tag not in _BLOCK and tag not in _LEFT_OUT:
            continue  # inline: its text belongs to the block around it
        end_block()
        for opened, closers in _CLOSED_BY.items():
            if tag in closers and (top.tag == opened):
                top = top.parent
        label, marked, suspect = _label(tag, attributes)
        inside_article = tag == "header" and ("/article" in top.path or "/main" in top.path)
        left_out = top.out or (tag in _LEFT_OUT and not inside_article) or (marked and not inside_article)
        links[1] = 0 if tag in _CONTAINER else links[1]
        top = _Node(tag, label, f"{top.path}/{label}", top, left_out, suspect)
    end_block()
    dense = {node for node, (size, linked) in suspects.items() if 2 * linked >= size}
    if not dense:
        return [(node, whole, linked) for node, _, whole, linked in out]

    def kept(node):
        while node:
            if node in dense:
                return False
            node = node.parent
        return True

    return [(node, whole, linked) for node, inner, whole, linked in out if kept(inner)]


def container_scores(found: list[tuple[_Node, str, int]]) -> dict[str, float]:
    """Score of each container path: text outside links, in full for the innermost container and by half
    for each one around it, with a bonus for elements that are meant to hold the main text."""
    scores: dict[str, float] = {}
    for node, text, linked in found:
        worth = max(0, len(text) - 2 * linked) + (20 if len(text) > 2 * linked else 0)
        while node.parent:
            if node.tag in _CONTAINER:
                bonus = 1.6 if node.tag in ("article", "main") else 1.0
                scores[node.path] = scores.get(node.path, 0.0) + worth * bonus
                worth /= 2
            node = node.parent
    return scores


def best_path(found) -> tuple[str, float]:
    scores = container_scores(found)
    return max(scores.items(), key=lambda x: (x[1], x[0]), default=("", 0.0))


def text_below(found, path: str) -> str:
    """The blocks in containers with this path, or in containers inside them."""
    return "\n".join(text for node, text, _ in found if node.path == path or node.path.startswith(path + "/"))


def widened(found, path: str) -> str:
    """The outermost path around this one whose further blocks are not mostly links: one of an article or main element
    if there is any, and none outside of these."""
    inside = lambda node, outer: node.path == outer or node.path.startswith(outer + "/")
    node = next((node for node, _, _ in found if inside(node, path)), None)
    while node and node.path != path:
        node = node.parent
    around = []
    while node:
        around.append(node)
        node = node.parent
    around.reverse()
    meant = [k for k, node in enumerate(around) if node.tag in ("article", "main")]
    order = [around[k] for k in meant] + [node for node in around[meant[0] if meant else 0 :] if node.tag not in ("article", "main")]
    for outer in order:
        further = [(len(text), linked) for node, text, linked in found if inside(node, outer.path) and not inside(node, path)]
        if 2 * sum(linked for _, linked in further) <= sum(n for n, _ in further):
            return outer.path
    return path


def host_of(url) -> F.Column:
    """Lower-case host of a URL, without user, port and a leading www. or m.; empty for a null or odd one."""
    host = F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.regexp_replace(host, r"^(?:www|m)\.", "")


def inner_texts(found, region: str) -> dict[str, int]:
    """Hash of the text in each container path below ``region``, of paths that hold less than half of its text."""
    parts: dict[str, list[str]] = {}
    for node, text, _ in found:
        while node.parent and node.path != region:
            if node.path.startswith(region + "/") and node.tag in _CONTAINER:
                parts.setdefault(node.path, []).append(text)
            node = node.parent
    whole = sum(len(text) for node, text, _ in found if node.path == region or node.path.startswith(region + "/"))
    return {path: _hash("\n".join(texts)) for path, texts in parts.items() if 2 * sum(map(len, texts)) < whole}


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def without_repeated(found, region: str, repeated: set[tuple[str, int]]):
    """The blocks that are in no container whose path and text are in ``repeated``."""
    gone = {path for path, text in inner_texts(found, region).items() if (path, text) in repeated} if repeated else set()

    def stays(node):
        while node:
            if node.path in gone:
                return False
            node = node.parent
        return True

    return [x for x in found if stays(x[0])] if gone else found


def host_rules(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, repeated) of the hosts that need any: the path that most of the pages vote for, by votes, score, name, null where
    all pages of a host vote for one path, as each of them knows it then; and the paths and texts of inner containers that are the
    same on most of the pages that have the path, on ``REPEATED_ON`` at least. Pages of equal main text count once."""

    def votes(batches):
        for b in batches:
            rows = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1)):
                found = blocks(page.as_py() or "")
                path, score = best_path(found)
                region = widened(found, path) if path else ""
                inner = inner_texts(found, region) if path else {}
                rows.append((host, path, score, None, None))
                main = _hash(text_below(without_repeated(found, region, set(inner.items())), region)) if inner else 0
                rows += [(host, p, None, t, main) for p, t in inner.items()]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "path", "score", "text", "page"])

    seen = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(votes, "host string, path string, score double, text long, page long")
    seen = written(seen.filter("path != ''"))
    counted = seen.filter("text is null").groupBy("host", "path").agg(F.count("*").alias("votes"), F.round(F.sum("score")).alias("score"))
    by_host = counted.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("path"), F.count("*").alias("paths"))
    texts = seen.filter("text is not null").select("host", "path", "text", "page").distinct().groupBy("host", "path", "text").agg(F.count("*").alias("n"))
    most = texts.groupBy("host", "path").agg(F.sum("n").alias("n"), F.max(F.struct("n", "text")).alias("most"))
    same = most.filter((F.col("most.n") >= REPEATED_ON) & (2 * F.col("most.n") > F.col("n"))).groupBy("host").agg(F.collect_list(F.struct("path", F.col("most.text").alias("text"))).alias("repeated"))
    return by_host.filter("paths > 1").select("host", "path").join(same, "host", "full")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_hosts: int = MAX_HOSTS) -> DataFrame:
    """(page_id, url, text, n_chars, path) of every row; ``path`` is that of the container the text was found by, null if there is no text.

    A null or empty page, or one without text, has an empty text. Pages without a readable host share the
    empty host. Repeated rows give repeated results, an empty table none; other columns are ignored. Pages are not shuffled: the rules of
    hosts that have any are broadcast, ``max_hosts`` and ``MAX_BYTES`` at once; pages of a host beyond that are read by a pass of their own.
    """
    rules = written(host_rules(pages, url_col, html_col))
    size = F.length(F.coalesce("path", F.lit(""))) + F.aggregate(F.coalesce("repeated", F.array().cast("array<struct<path:string,text:bigint>>")), F.lit(100), lambda n, x: n + 100 + F.length(x["path"]))
    n, n_bytes = rules.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    passes = max(1, -(-n // max_hosts), -(-n_bytes // MAX_BYTES))

    def read(batches):
        for b in batches:
            texts, paths = [], []
            for page, path, repeated in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
                found = blocks(page.as_py() or "")
                here = path if path and text_below(found, path) else best_path(found)[0]
                region = widened(found, here)
                texts.append(text_below(without_repeated(found, region, {(x["path"], x["text"]) for x in repeated or []}), region))
                paths.append(here if texts[-1] else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string())], names=["page_id", "url", "text", "n_chars", "path"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    out = None
    for k in range(passes):
        mine = F.pmod(F.xxhash64("host"), F.lit(passes)) == k
        some, own = (rows.filter(mine), rules.filter(mine)) if passes > 1 else (rows, rules)
        found = some.join(F.broadcast(own), "host", "left").select("page_id", "url", "html", "path", "repeated").mapInArrow(read, "page_id long, url string, text string, n_chars long, path string")
        out = found if out is None else out.unionByName(found)
    return out
