"""Main text of web pages by composite text density.

A page becomes a tree with a tolerant tag scanner.  Every node gets its composite text density: characters per tag, adjusted by how many of them
are links,

    c / t * log_b(c * t' / (c' * t'')),   b = ln(c / nc * c' + lc_body / c_body * c + e)

with c characters, t tags, c' link characters, nc other characters, t' all tags, t'' link tags.  The sum of its children's densities chooses the node: the
largest sum is the text's subtree.  The least density on the path from that node up to the body is the threshold; any other branch at or above it
gives its own largest-sum subtree too, and so on in what that leaves of the branch, so that an article in several parts stays whole.  Text that lies beside
blocks counts as a branch, and headings beside the path belong to it.  Article and main elements choose nothing; they are a weight: a branch that is one or
lies in one counts up to ``MARKED`` times against the threshold, by the share of its characters outside of links.

Before that, branches that can't be the article are cut: by tag, role and by class and id (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments, hidden ones).  A class cuts only if all its words are of that kind (``ad-banner``, not ``post-form``), on a paragraph or heading only if it names an advert or notice; and nothing is cut
that holds more than half of the page's text outside of links and all its article and main elements, if it has any, so that density has the last word.  Scanning is linear in the length of the page, however broken its tags are.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import text_of

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Fixed values of the HTML standard: elements without content, elements of raw text, elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BLOCK = ENDS_P | frozenset("body html li dt dd tr td th caption thead tbody tfoot br option summary".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
RUN = INLINE | {"br", "wbr", "img"}
MARKS = ("article", "main")
CUT_TAGS = RAW | frozenset("head nav footer aside form button select input dialog menu object embed canvas audio video map".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar tablist status".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adslot adsense banner banners sponsor sponsored sponsors promo promos promotion promoted outbrain taboola "
    "nav navbar navigation navi menu menus breadcrumb breadcrumbs pagination pager toolbar sitenav topbar header masthead footer colophon copyright sidebar sidebars rail aside "
    "widget widgets related recommended recommendations share sharing social follow newsletter subscribe subscription signup login notice notices notification notifications cookie cookies consent gdpr "
    "alert popup modal overlay disclaimer form search comment comments commentlist disqus respond responses replies reply discussion reactions hidden skip".split()
)
#: Words that may stand beside those in a class without making it another one.
BESIDE = frozenset("site page main top bottom left right global primary secondary container wrapper wrap inner outer box block list item items area section bar links link user reader unit slot google dfp mobile desktop js is has u c l o the and more".split())
#: Words for the article itself; beside one of these only the words after them name clutter (``post-comments``, not ``post-form``).
OWN = frozenset("post article entry story".split())
OF_OWN = frozenset("comment comments commentlist disqus nav navigation pagination share sharing social related recommended footer sidebar ad ads newsletter".split())
#: What cuts a paragraph or heading too.
CUT_TEXT = frozenset("ad ads advert adverts advertisement advertising sponsored promo promoted cookie cookies consent gdpr notice notification disclaimer copyright breadcrumb breadcrumbs share newsletter hidden".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd dt".split())
#: An article's own header keeps headings, and what has this many words: a standfirst, not a byline.
STANDFIRST = 8
#: Weight of article and main elements against the threshold, by the share of text outside of links: their short paragraphs reach it, their lists of links do not.
MARKED = 32
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "up", "items", "chars", "tags", "link_chars", "link_tags", "density", "total", "inline", "best")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.attrs, self.up, self.items = tag, attrs, up, []


class _Open:
    """The open elements, with what is needed to answer in constant time whether one of a kind is open below a bound."""

    def __init__(self, root: Node):
        self.stack, self.counts = [root], {}
        self.blocks, self.enders = [], [{}]  # open elements of BLOCK; per open element of ENDS_P the inline ones open in it

    def push(self, node: Node) -> None:
        tag = node.tag
        self.stack.append(node)
        self.counts[tag] = self.counts.get(tag, 0) + 1
        if tag in BLOCK:
            self.blocks.append(tag)
        if tag in ENDS_P:
            self.enders.append({})
        elif tag in INLINE:
            self.enders[-1][tag] = self.enders[-1].get(tag, 0) + 1

    def pop(self) -> Node:
        node = self.stack.pop()
        tag = node.tag
        self.counts[tag] -= 1
        if tag in BLOCK:
            self.blocks.pop()
        if tag in ENDS_P:
            self.enders.pop()
        elif tag in INLINE:
            self.enders[-1][tag] -= 1
        return node

    def close(self, names) -> None:
        """Close elements up to the first of ``names``, itself included."""
        while self.pop().tag not in names:
            pass

    def paragraph(self) -> bool:
        """Whether a paragraph is open with no other block in it."""
        return bool(self.blocks) and self.blocks[-1] == "p"

    def within(self, names, bounds) -> bool:
        if not any(self.counts.get(x) for x in names):
            return False
        for node in reversed(self.stack):
            if node.tag in names:
                return True
            if node.tag in bounds:
                return False
        return False


def parse(page: str) -> Node:
    """The page's tree; its items are nodes and strings, in page order. Tags that don't match are closed where the standard closes them."""
    root = Node("html", "", None)
    now, at = _Open(root), 0
    for start, end, close, name, attrs, selfclosing in iter_tags(page):
        if start > at:
            now.stack[-1].items.append(page[at:start])
        at = end
        if name is None:
            continue
        if close:
            if name == "p" and not now.paragraph() or not now.counts.get(name) or name in INLINE and not now.enders[-1].get(name):  # a stray inline end doesn't close blocks
                continue
            now.close((name,))
            continue
        if name == "html" and len(now.stack) == 1:
            continue
        if name in ENDS_P and now.paragraph():
            now.close(("p",))
        if name in CLOSES and now.within(*CLOSES[name]):
            now.close(CLOSES[name][0])
        node = Node(name, attrs, now.stack[-1])
        now.stack[-1].items.append(node)
        if name not in VOID and not selfclosing and name not in RAW:
            now.push(node)
    if at < len(page):
        now.stack[-1].items.append(page[at:])
    return root


def iter_tags(page: str) -> Iterator[tuple]:
    """(start, end, is end tag, name or None, attributes, closes itself); raw-text elements are one tag with their content."""
    at, last, no_end = 0, page.rfind(">"), set()
    quotes, plain = {q: page.rfind(q) for q in "\"'"}, False
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4) if last > start else -1
            at = end + 3 if end >= 0 else len(page)
            yield start, at, False, None, "", False
            continue
        if start > last:  # no tag ends any more; a comment still could
            if page.find("<!--", start) < 0:
                return
            continue
        if page.startswith("<![CDATA[", start) and "cdata" not in no_end:
            end = page.find("]]>", start)
            if end < 0:
                no_end.add("cdata")
            else:
                at = end + 3
                yield start, at, False, None, "", False
                continue
        if page[at : at + 1] in ("!", "?"):
            at = page.find(">", start) + 1
            yield start, at, False, None, "", False
            continue
        m = _NAME.match(page, at)
        if m is None:
            continue
        end = -1 if plain else _tag_end(page, m.end(), quotes)
        if end < 0:  # quotes hide all ends from here on: from now on the next one counts, quoted or not
            plain, end = True, page.find(">", start)
        attrs, name = page[m.end() : end], m[2].lower()
        selfclosing, at = attrs.endswith("/"), end + 1
        if name in RAW and not m[1] and not selfclosing and name not in no_end:
            found = _raw_end(name).search(page, at)
            if found:
                at = found.end()
            else:
                no_end.add(name)
        if name in no_end and name in ("script", "style", "textarea", "title") and not m[1] and not selfclosing:
            at = len(page)
        yield start, at, bool(m[1]), name, attrs, selfclosing


@lru_cache(maxsize=None)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?:\s[^>]*|/[^>]*)?>", re.I)


_MARK = re.compile("[>\"']")


def _tag_end(page: str, at: int, quotes: dict[str, int]) -> int:
    """Place of the first > outside of quotes, -1 if there is none; a quote without a second one is an ordinary character."""
    while m := _MARK.search(page, at):
        c, at = m[0], m.end()
        if c == ">":
            return m.start()
        if quotes[c] >= at:
            at = page.find(c, at) + 1
    return -1


def _is_cut(node: Node) -> bool:
    tag = node.tag
    if tag in CUT_TAGS:
        return True
    if node.attrs and tag not in ("html", "body"):
        for m in _ATTR.finditer(node.attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                if tag not in MARKS and any(_names_clutter(x, tag) for x in value.split()):
                    return True
            elif key == "role" and value.strip().lower() in CUT_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                return True
    return False


def _names_clutter(name: str, tag: str) -> bool:
    """Whether one class or id consists of words for what isn't the article."""
    words = [w.lower() for w in _WORDS.findall(name) if not w.isdigit()]
    known = CUT_TEXT if tag in TEXT_TAGS else CUT_WORDS
    if any(w in OWN for w in words):
        known, words = known & OF_OWN, [w for w in words if w not in OWN]
    return any(w in known for w in words) and all(w in known or w in BESIDE for w in words)


def _prune(node: Node, inside: bool, half: float, marked: set[int] | None) -> None:
    """Cut what can't be the article, unless it holds more than ``half`` characters outside of links and, if the page has ``marked`` elements, one of these."""
    kept = []
    for x in node.items:
        if isinstance(x, Node):
            bulk = x.tag not in RAW and x.chars - x.link_chars > half and (marked is None or id(x) in marked)
            if x.tag == "header" and not bulk:  # an article's own header is its title, perhaps with a standfirst
                if not inside:
                    continue
                x.items = [y for y in x.items if isinstance(y, Node) and (re.fullmatch("h[1-6]|hgroup", y.tag) or y.chars - y.link_chars > y.link_chars and len(_text(y).split()) >= STANDFIRST)]
            elif _is_cut(x) and not bulk:
                continue
            elif x.tag == "article" and inside and not bulk and re.search("comment|reply", x.attrs, re.I):
                continue
            _prune(x, inside or x.tag in MARKS, half, marked)
        kept.append(x)
    node.items = kept


def _text(node: Node) -> str:
    return " ".join(_text(x) if isinstance(x, Node) else x for x in node.items)


def _measure(node: Node, in_link: bool) -> None:
    node.chars = node.link_chars = node.link_tags = 0
    node.tags, node.inline = 0, node.tag in RUN
    link = in_link or node.tag == "a"
    for x in node.items:
        if isinstance(x, Node):
            _measure(x, link)
            node.chars += x.chars
            node.tags += x.tags + 1
            node.link_chars += x.link_chars
            node.link_tags += x.link_tags + (x.tag == "a")
            node.inline &= x.inline
        else:
            n = len(x.strip())
            node.chars += n
            if link:
                node.link_chars += n


def _density(c: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    if not c:
        return 0.0
    t, lc, lt, nc = max(1, tags), max(1, link_chars), max(1, link_tags), max(1, c - link_chars)
    base = math.log(c / nc * lc + ratio * c + math.e)
    return c / t * math.log(max(1.0 + 1e-9, c / lc * t / lt)) / math.log(max(base, 1.0 + 1e-9)) if base > 0 else 0.0


def _densities(node: Node, ratio: float) -> None:
    node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
    node.total, own, below = 0.0, 0, None
    for x in node.items:
        if not isinstance(x, Node):
            own += len(x.strip())
            continue
        _densities(x, ratio)
        if x.inline:
            own += x.chars - x.link_chars
        else:
            node.total += x.density
            if below is None or x.best.total > below.total:
                below = x.best
    # Text that a node holds itself, inline elements with it, counts like a child of its own.
    if own and node.tag != "a":
        node.total += own / max(1, node.tags)
    node.best = below if below is not None and below.total > node.total else node


def _is_heading(node: Node) -> bool:
    """Whether all of a node's text lies in headings."""
    if re.fullmatch("h[1-6]|hgroup", node.tag):
        return True
    return all(_is_heading(x) if isinstance(x, Node) else not x.strip() for x in node.items)


def _reaches(run: list, threshold: float, ratio: float, marked: bool) -> bool:
    """Whether a branch, or text and inline elements that follow each other, reaches the threshold."""
    nodes = [x for x in run if isinstance(x, Node)]
    c, links = sum(x.chars if isinstance(x, Node) else len(x.strip()) for x in run), sum(x.link_chars for x in nodes)
    if len(run) == len(nodes) == 1 and not nodes[0].inline:
        density = nodes[0].density
    else:
        density = _density(c, sum(x.tags + 1 for x in nodes), links, sum(x.link_tags + (x.tag == "a") for x in nodes), ratio)
    return density * (max(1.0, MARKED * (1 - links / c)) if marked and c else 1.0) >= threshold


def _collect(node: Node, threshold: float, ratio: float, marked: bool, out: list) -> None:
    """What is text in a branch, in page order: its largest-sum subtree, and beside the path to that the branches that reach the threshold."""
    if node.best is node:
        out.append(node)
        return
    marked = marked or node.tag in MARKS
    run: list = []
    for x in [*node.items, None]:
        if isinstance(x, str) or x is not None and x.inline:
            run.append(x)
            continue
        if run:
            if _reaches(run, threshold, ratio, marked):
                out.extend(run)
            run = []
        if x is None or not x.chars:
            continue
        if x.best is node.best or _is_heading(x) or _reaches([x], threshold, ratio, marked or x.tag in MARKS):
            _collect(x, threshold, ratio, marked, out)


def _blocks(node: Node, out: list[str]) -> None:
    block = node.tag in BLOCK
    if block:
        out.append("\n")
    for x in node.items:
        if isinstance(x, Node):
            _blocks(x, out)
        else:
            out.append(x)
    if block:
        out.append("\n")


def extract(page: str) -> str:
    """The main text of one page: blocks in page order, white space in them and between them one space."""
    if "<" not in page:
        return " ".join(_html.unescape(page).split())
    root = parse(page)
    body = next((x for x in _walk(root) if x.tag == "body"), root)
    _measure(body, False)
    marked: set[int] = set()  # article and main elements and what they lie in
    for x in _walk(body):
        if x.tag in MARKS:
            while x is not None and id(x) not in marked:
                marked.add(id(x))
                x = x.up
    _prune(body, False, (body.chars - body.link_chars) / 2, marked or None)
    _measure(body, False)
    if not body.chars:
        return ""
    ratio = body.link_chars / body.chars
    _densities(body, ratio)
    threshold, x = body.best.density, body.best
    while x is not body:
        x = x.up
        threshold = min(threshold, x.density)
    chosen: list = []
    _collect(body, threshold, ratio, False, chosen)
    out: list[str] = []
    for x in chosen:
        if isinstance(x, str):
            out.append(x)
        else:
            if x.tag not in INLINE:
                out.append("\n")
            _blocks(x, out)
    text = "".join(out)
    return " ".join((_html.unescape(text) if "&" in text else text).split())


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [y for y in reversed(x.items) if isinstance(y, Node)]


def safe_extract(page: str) -> str:
    """``extract``, with room for deeply nested pages."""
    import sys

    import threading

    found: list = []
    old, size = sys.getrecursionlimit(), threading.stack_size(512 << 20)
    sys.setrecursionlimit(max(old, min(4 * page.count("<") + 1000, 1_000_000)))
    try:
        worker = threading.Thread(target=lambda: found.append(extract(page)))
        worker.start(), worker.join()
    finally:
        threading.stack_size(size), sys.setrecursionlimit(old)
    return found[0]


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars (code points). Null html counts as empty, whose text is empty; repeated rows give repeated rows; other columns are not read."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_depth_safe(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = pages.select(pages[id_col].alias(id_col), pages[url_col].alias(url_col), text_of(pages, html_col).alias("__html"))
    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")


def _depth_safe(page: str) -> str:
    try:
        return extract(page)
    except RecursionError:  # nested deeper than the interpreter's stack: again, with a stack of its own
        return safe_extract(page)
