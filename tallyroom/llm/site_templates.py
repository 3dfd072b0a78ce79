"""Main text of web pages by removal of site templates.

Every element is hashed with all below it (tag, text, children).  Spark counts, per host, on how many pages a hash occurs; what
occurs on a ``share`` of the host's pages, and on ``least_pages`` at least, is template.  A page's elements with such a hash are deleted; then what its markup
itself names as something other than the article (navigation, forms, adverts, notices, comments ...: by tag, role, or a whole class or id, so that
``ad-hoc`` names nothing); the article is chosen from what is left, and its text, or that of the body where none is
marked, is what remains.  A page whose only text is template keeps it.

Pages of one host are different if both their urls and their contents are: a page that was crawled three times is one, and so are mirrors of it; their body is no template.
An element that holds an article (``article`` or ``main``) is never template, nor is the article itself, nor, by itself, an inline element, whose
loss would tear a sentence.  Inside an article only containers
(``CONTAINERS``) can be, not its paragraphs, headings, lists and the like, and there a hash counts once for each different article, not for each page: so the
paragraphs that versions of an article share, and all of an article that is copied to many pages, stay.

Hashes are told apart and counted in combined sums, so a host with a third of all pages costs no task more.  A template is on a ``share`` of its host's
pages, so a host has at most 1 / ``share`` as many as its mean page has elements; this list, whose size is of the order of a page, goes to the host's pages in a join whose smaller
side Spark broadcasts if its measured size allows, and else splits where it is skewed.  Pages are parsed whole, twice, and nothing else is held.

A null or empty html gives an empty text; a url without a host counts as a host of its own.
Unclosed and stray tags are tolerated as browsers do; an unclosed comment or script runs to the end.  Character references are decoded in each
text by itself, so that markup between two texts makes no reference of their ends.  Elements may be nested to
any depth, very long pages are worked on whole, an empty table gives an empty table, ties do not matter (a hash is template or
not), and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.arrays import lean
from tallyroom.llm.tables import kept

LEAST_PAGES, SHARE = 3, 0.3
HOSTS = 64

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")

# Classes of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
REGIONS = frozenset(("article", "main"))
CONTAINERS = frozenset("aside dialog div footer form header nav section".split())
NOT_TEXT = frozenset("head title nav footer aside form script style noscript template iframe svg math canvas object embed button select textarea input dialog menu audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset("nav navbar navigation menu header masthead footer sidebar aside cookie cookies consent gdpr notice notices banner ad ads advert adverts advertisement sponsor sponsored promo promotion comments comment disqus share sharing social related breadcrumb breadcrumbs newsletter subscribe signup popup modal overlay pagination pager widget".split())


class Node:
    __slots__ = ("tag", "attrs", "inside", "mark", "holds")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.inside, self.mark, self.holds = tag, attrs, [], None, False


class Open:
    """The elements that are open, and how many of each tag, so that tags that are not open are not searched for."""

    def __init__(self, root: Node):
        self.stack, self.count = [root], Counter()

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.count[node.tag] += 1

    def cut(self, k: int) -> None:
        """Close the k-th and all inside it."""
        self.count.subtract(x.tag for x in self.stack[k:])
        del self.stack[k:]

    def close(self, tags: frozenset | set, stop: frozenset | set, all_: bool = False) -> None:
        """Close the innermost of ``tags`` (or all of them) that no ``stop`` is inside of."""
        left = sum(self.count[t] for t in tags)
        for k in range(len(self.stack) - 1, 0, -1):
            if not left:
                return
            tag = self.stack[k].tag
            if tag in tags:
                left -= 1
                self.cut(k)
                if not all_:
                    return
            elif tag in stop:
                return


def parse(page: str) -> Node:
    """The tree of a page.  Children are nodes and texts; references in texts are not yet decoded."""
    root = Node("")
    open_, at, size = Open(root), 0, len(page)
    stack = open_.stack
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            stack[-1].inside.append(page[at:])
            break
        if m.start() > at:
            stack[-1].inside.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].inside.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            open_.close({tag}, frozenset())
            continue
        if tag in CLOSES_P:
            open_.close({"p"}, BLOCK)
        if tag in SIBLINGS:
            open_.close(SIBLINGS[tag], SCOPES[tag], all_=True)
        node = Node(tag, m[3])
        stack[-1].inside.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK | RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else size
            if stop > at:
                node.inside.append(page[at:stop])
            at = page.find(">", stop) + 1 if end else size
            at = at or size
            continue
        open_.push(node)
    return root


def named(node: Node) -> bool:
    """Whether tag or attributes say that this is no part of the article."""
    if node.tag in NOT_TEXT:
        return True
    if not node.attrs or node.tag in ("article", "main", "body", "html"):
        return False
    for m in ATTRIBUTE.finditer(node.attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and not NAMES.isdisjoint(value.split()):
            return True
    return False


def mark(root: Node) -> tuple[int, set[tuple[int, int]]]:
    """Hash every element, children first.  Elements that can be template keep their hash; what is returned are the page's hash, and these hashes with that
    of the article around them (of the page if none)."""
    order: list[tuple[Node, Node | None]] = []
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        node, region = todo.pop()
        order.append((node, region))
        inner = region or (node if node.tag in REGIONS else None)
        todo += [(x, inner) for x in node.inside if not isinstance(x, str)]
    for node, _ in reversed(order):
        digest = hashlib.blake2b(node.tag.encode(), digest_size=8)
        node.holds = node.tag in REGIONS
        for x in node.inside:
            if isinstance(x, str):
                digest.update(b"\0" + " ".join(x.split()).encode("utf-8", "replace"))
            else:
                digest.update(b"\1" + x.mark.to_bytes(8, "little", signed=True))
                node.holds |= x.holds
        node.mark = int.from_bytes(digest.digest(), "little", signed=True)
    page = root.mark
    able = [(node, (region or root).mark) for node, region in order if node.inside and not node.holds and node.tag in (BLOCK if region is None else CONTAINERS)]
    found = {(node.mark, key) for node, key in able}
    kept_ = {id(node) for node, _ in able}
    for node, _ in order:
        if id(node) not in kept_:
            node.mark = None
    return page, found


def main_text(root: Node, templates: set[int]) -> str:
    """Text left in the article (else main, else all) without templates and named parts."""
    regions: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        if node.mark in templates or named(node):
            continue
        if node.tag in regions:
            if node.tag == "main" or not within:
                regions[node.tag].append(node)
            within = within or node.tag == "article"
        todo += [(x, within) for x in reversed(node.inside) if not isinstance(x, str)]
    chosen = regions["article"] or regions["main"][:1] or [root]
    marked = chosen != [root]
    out: list[str] = []
    work: list = list(reversed(chosen))
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(entities.unescape(x))
            continue
        if x.mark in templates or named(x) or x.tag == "header" and not marked:
            continue
        if x.tag in BLOCK:
            out.append("\n")
            work.append("\n")
        work += reversed(x.inside)
    return " ".join("".join(out).split())


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))


def templates(rows: DataFrame, least_pages: int, share: float) -> DataFrame:
    """host, marks: the hashes of each host's templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[str, int, int, int | None]] = set()
            for host, url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                whole, found = mark(parse(page.as_py() or ""))
                seen.add((host, url, whole, None))
                seen.update((host, url, around, hash_) for hash_, around in found)
            if seen:
                host, url, within, hash_ = zip(*seen)
                yield pa.RecordBatch.from_pydict({"host": list(host), "at": pa.array(url, pa.int64()), "within": pa.array(within, pa.int64()), "mark": pa.array(hash_, pa.int64())})

    found = rows.select("host", F.xxhash64("url").alias("at"), "html").mapInArrow(lean(run), "host string, at long, within long, mark long")
    counts = kept(found.groupBy("host", "mark").agg(F.least(F.count_distinct("at"), F.count_distinct("within")).alias("n")).where(F.col("mark").isNull() | (F.col("n") >= least_pages)), "counts")
    pages = counts.where("mark IS NULL").select("host", F.col("n").alias("pages"))
    return counts.where("mark IS NOT NULL").join(pages, "host").where(F.col("n") >= share * F.col("pages")).groupBy("host").agg(F.collect_list("mark").alias("marks"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars, n_templates (how many template hashes its host has): one row per page."""
    rows = _pages(pages, id_col, url_col, html_col)
    known = kept(templates(rows, least_pages, share), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host: dict[str, set[int]] = {}
        for batch in batches:
            texts, sizes, lists = [], [], batch.column(3)
            for host, page, listed in zip(batch.column(4).to_pylist(), batch.column(2), lists):
                if (hashes := by_host.get(host)) is None:
                    if len(by_host) >= HOSTS:
                        by_host.clear()
                    hashes = by_host[host] = set(listed.as_py() or ())
                root = parse(page.as_py() or "")
                if hashes:
                    mark(root)
                texts.append(main_text(root, hashes) or main_text(root, set()))
                sizes.append(len(hashes))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "n_templates": pa.array(sizes, pa.int64())})

    id_type = pages.schema[id_col].dataType.simpleString()
    return rows.join(known, "host", "left").select("page_id", "url", "html", "marks", "host").mapInArrow(lean(run), f"page_id {id_type}, url string, text string, n_chars long, n_templates long")
