"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each under a root-to-leaf path of its enclosing
block elements (name, class and id; inline elements are left out, so a bold
word stays with its paragraph).  Per path the text length, the punctuation and
the text inside links are added up over its nodes.  The ratio of text to path
is the mean text length per node, fused with the punctuation ratio and lowered
by the share of links; the ratios are smoothed along the page's nodes, and the
paths at or above a share of their text-weighted mean are content paths.

All their text is returned.  So are the headings and short blocks between its
first and last node and elsewhere in the content container: the deepest element
that holds all of it, or the article element around that one.  Without such an
element the title, a heading before the container, is returned with the short
blocks that follow it.  Only blocks of links on paths below the threshold are
left out (most of the block's text, and of its run of such blocks, in links).

Elements that are never article text (menus, headers, footers, asides, forms,
scripts, styles, and elements whose class, id or role says advert, notice,
comments and so on) take no part.

Defined cases: a null, empty or text-free html gives the empty text; text
outside any tag counts as a page of one path; broken markup (unclosed or
misplaced tags, bare ``<``, cut-off pages) is read as far as it goes; pages are
independent, so repeated rows and ties have no effect; other columns are
ignored.  Whole pages are read; nothing is cut.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoich.llm.common import bounded_batches
from stoich.llm.words import text_chunks

# Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style noscript template nav footer aside form button select option optgroup textarea "
                  "svg iframe object embed canvas video audio map dialog menu datalist title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
                     "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
                "th": ("tr", "table"), "option": ("select", "datalist")}
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "comment comments respond replies disqus related recommended recommendations widget toolbar pagination pager "
    "search form skip copyright".split())
NOT_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu "
                              "menubar toolbar".split())
SHARE = 0.3          # of the weighted mean ratio that makes a content path
LINKS = 0.5          # of the text of a block, from which on it is a block of links
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of text, not containers: what stands beside them belongs to the article too.
TEXTUAL = HEADINGS | frozenset("p li ul ol dl dt dd pre blockquote figure figcaption table caption thead tbody tfoot "
                               "tr".split())
SPREAD = 1.0         # width of the smoothing, in text nodes

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)""")
_ATTR = re.compile(r"""(?<![^\s=/>"'])([^\s=/>"']++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+)""")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?…。、，；：！？]")


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for k, v in _ATTR.findall(text):
        found.setdefault(k.lower(), v[1:-1] if v[:1] in "\"'" else v)
    return found


def _left_out(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in NEVER or (name == "header" and not in_article):
        return True
    if name in ("html", "body", "article", "main"):
        return False
    if attrs.get("role", "").lower() in NOT_ARTICLE_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True
    words = _WORD.findall(_CAMEL.sub(" ", attrs.get("class", "") + " " + attrs.get("id", "")).lower())
    return any(w in NOT_ARTICLE for w in words) or ("header" in words and not in_article)


class Paths:
    """Root-to-leaf paths as numbers: a path is its parent and one element, and
    equal paths have equal numbers (0 is the root).  Parents come first."""

    def __init__(self):
        self.parent, self.depth, self.name = [0], [0], [""]
        self._known: dict[tuple[int, str], int] = {}

    def child(self, parent: int, label: str) -> int:
        key = (parent, label)
        if key not in self._known:
            self._known[key] = len(self.parent)
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            self.name.append(label.split(".")[0])
        return self._known[key]

    def common(self, a: int, b: int) -> int:
        """The deepest path that both are under."""
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return a

    def around(self, path: int) -> list[int]:
        """The path and all around it, deepest first."""
        out = [path]
        while path:
            path = self.parent[path]
            out.append(path)
        return out

    def under(self, path: int) -> list[bool]:
        """Per path whether it is ``path`` or below it."""
        out = [False] * len(self.parent)
        for i, up in enumerate(self.parent):
            out[i] = i == path or (i > 0 and out[up])
        return out


class _Element:
    __slots__ = ("name", "path", "out", "link", "article", "inline")

    def __init__(self, name, path, out, link, article, inline):
        self.name, self.path, self.out = name, path, out
        self.link, self.article, self.inline = link, article, inline


def text_nodes(page: str, paths: Paths) -> Iterator[tuple[int, str, bool, bool]]:
    """(path, raw text, in a link, starts a block) of every text node that is
    not left out, in page order."""
    stack = [_Element("", 0, False, False, False, False)]
    opened: Counter[str] = Counter()        # elements of the stack by name
    at, fresh = 0, True

    def leave(i: int) -> None:
        opened.subtract(e.name for e in stack[i:])
        del stack[i:]

    def pop_to(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                leave(i)
                return
            if stack[i].name in stop:
                return

    while at < len(page):
        m = _TAG.search(page, at)
        upto = m.start() if m else len(page)
        if upto > at and not stack[-1].out:
            yield stack[-1].path, page[at:upto], stack[-1].link, fresh
            fresh = False
        if not m:
            break
        at = m.end()
        token = m[0]
        if token == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if token in ("<!", "<?"):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], "")
        if not m[2]:                    # a quote that never ends: up to the next >
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
        name = name.lower()
        block = name not in INLINE
        fresh = fresh or block or name == "br"
        if closing:
            for i in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[i].name == name:
                    leave(i)
                    break
                if not block and not stack[i].inline:
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if end is None:
                at = len(page)
            else:
                close = page.find(">", end.start())
                at = len(page) if close < 0 else close + 1
            continue
        if name in VOID or rest.endswith("/") and name not in INLINE:
            if name in CLOSES_P:
                pop_to(("p",), ("button", "td", "th", "table"))
            continue
        if name in CLOSES_P:
            pop_to(("p",), ("button", "td", "th", "table", "article", "section", "div"))
        elif name in SELF_CLOSING:
            pop_to((name,) if name not in ("dt", "dd") else ("dt", "dd"), SELF_CLOSING[name])
        top = stack[-1]
        attrs = _attributes(rest) if rest.strip() else {}
        if "hidden" in rest.split():
            attrs["style"] = "display:none"
        out = top.out or _left_out(name, attrs, top.article)
        path = top.path
        if block:
            path = paths.child(path, f"{name}.{attrs.get('class', '')}#{re.sub(r'[0-9]+', '0', attrs.get('id', ''))}")
        opened[name] += 1
        stack.append(_Element(name, path, out, top.link or name == "a", top.article or name in ("article", "main"),
                              not block))


def content_paths(nodes: list[tuple[int, int, int, bool]]) -> set[int]:
    """Paths whose smoothed, fused ratio reaches the threshold; a node is
    (path, text length, punctuation, in a link)."""
    total: dict[int, list[float]] = {}
    for path, n, punct, link in nodes:
        t = total.setdefault(path, [0.0, 0.0, 0.0, 0.0])
        t[0] += n
        t[1] += 1
        t[2] += punct
        t[3] += n * link
    ratio = {p: (t[0] / t[1]) * (1 + 10 * t[2] / t[0]) * (1 - t[3] / t[0]) for p, t in total.items()}
    raw = [ratio[path] for path, *_ in nodes]
    kernel = {d: exp(-d * d / (2 * SPREAD * SPREAD)) for d in range(-2, 3)}
    smooth: dict[int, list[float]] = {}
    for i, (path, n, _, _) in enumerate(nodes):
        span = [(raw[i + d], k) for d, k in kernel.items() if 0 <= i + d < len(raw)]
        value = sum(v * k for v, k in span) / sum(k for _, k in span)
        s = smooth.setdefault(path, [0.0, 0.0])
        s[0] += value
        s[1] += 1
    score = {p: s[0] / s[1] for p, s in smooth.items()}
    mean = sum(score[p] * t[0] for p, t in total.items()) / sum(t[0] for t in total.values())
    return {p for p, s in score.items() if s >= SHARE * mean}


def _container(chosen: set[int], paths: Paths) -> int:
    """The deepest element around all of the paths, or the article around it."""
    best = reduce(paths.common, chosen)
    # a cell with text of its own is one of many, else it lays out the page
    while paths.name[best] in TEXTUAL or paths.name[best] in ("td", "th") and best in chosen:
        best = paths.parent[best]
    for i in paths.around(best):
        if paths.name[i] == "article":
            return i
    return best


def _link_blocks(nodes: list[tuple[int, str, bool, bool, int, int]], chosen: set[int], paths: Paths) -> list[bool]:
    """Whether each node is in a block of links on a path that was not chosen."""
    block, run, b, r, last = [], [], -1, -1, None
    for path, _, _, fresh, n, _ in nodes:
        b += fresh or b < 0
        if n and path != last:
            r, last = r + 1, path
        block.append(b)
        run.append(max(r, 0))
    text: list[list[int]] = [[0] * (b + 1), [0] * (max(r, 0) + 1)]
    linked: list[list[int]] = [[0] * (b + 1), [0] * (max(r, 0) + 1)]
    for (_, _, link, _, n, _), *at in zip(nodes, block, run):
        for k, i in enumerate(at):
            text[k][i] += n
            linked[k][i] += n * link
    return [path not in chosen and paths.name[path] not in HEADINGS
            and all(linked[k][i] > LINKS * text[k][i] for k, i in enumerate(at))
            for (path, *_), *at in zip(nodes, block, run)]


def _kept(nodes: list[tuple[int, str, bool, bool, int, int]], chosen: set[int], paths: Paths) -> list[bool]:
    """Whether the text of each node is returned."""
    best = _container(chosen, paths)
    under = paths.under(best)
    inside = [under[path] for path, *_ in nodes]
    solid = [i for i, x in enumerate(nodes) if x[4]]
    content = [i for i in solid if nodes[i][0] in chosen]
    name = lambda i: paths.name[nodes[i][0]]
    first, last = next(i for i in solid if inside[i]), content[-1]
    if paths.name[best] != "article" and not any(inside[i] and name(i) == "h1" for i in solid):
        around = set(paths.around(best))
        before = [i for i in solid if i < first and name(i) in HEADINGS]
        near = [i for i in before if paths.parent[nodes[i][0]] in around]
        title = near or [i for i in before if name(i) == "h1"]
        if title:
            first = title[-1]
            at = solid.index(first)
            while at and name(solid[at - 1]) in HEADINGS:
                at -= 1
            first = solid[at]
    links = _link_blocks(nodes, chosen, paths)
    return [(inside[i] or first <= i <= last) and not links[i] for i in range(len(nodes))]


def main_text(page: str | None) -> str:
    """The article's text, blocks joined by one space."""
    if not page:
        return ""
    nodes, paths = [], Paths()
    for path, raw, link, fresh in text_nodes(page, paths):
        text = htmllib.unescape(raw)
        n = len("".join(text.split()))
        nodes.append((path, text, link, fresh, n, len(_PUNCT.findall(text))))
    solid = [(p, n, punct, link) for p, _, link, _, n, punct in nodes if n]
    if not solid:
        return ""
    kept = _kept(nodes, content_paths(solid), paths)
    parts = []
    for (_, text, _, fresh, _, _), inside in zip(nodes, kept):
        if fresh or not inside:
            parts.append(" ")
        if inside:
            parts.append(text)
    return " ".join("".join(parts).split())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "html"):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"),
                        F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
