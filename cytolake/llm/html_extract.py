"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A logistic classifier over each block's tag, place in the document tree and in the
page, names of the elements around it, length, punctuation and link density gives the log-odds that it is content: these
are the capacities to the source (content) and to the sink (boilerplate). Neighbours in page order and blocks under one
parent are tied by smoothness edges whose capacity grows with the depth of tree that they share. The minimum cut is the
cheapest labelling. Blocks whose own cost outweighs all their ties are settled first and pass their ties on; max-flow
(Dinic) runs on what is left. The weights are fitted in ``html_labels`` on pages whose blocks are labelled.

Names count as one bounded feature, whatever the number of words that match: the share of a name's parts (camel case and
hyphens split) that mark boilerplate, so ``social-history`` weighs half of ``social``. An article or main element ends
what its wrappers said, but for reader comments. An inline element with such a name is a block of its own inside its
paragraph.

Pages are independent: no shuffle, and a page is held by one task only while it is read. Null html is an empty text.
Unclosed and stray tags are closed as browsers do for blocks; time is linear in the page, however deep or broken it is.
Character references are decoded, white space inside a block becomes one space, blocks are joined by one space, and
nothing else is dropped or cut. Repeated pages get equal texts; an empty table gives an empty result; no column but
page_id, url and html counts, whatever its name; a block whose cost and ties are even is boilerplate.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?P<ends>-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title)(?=[\s/>])[^>]*>.*?(?P<closed></(?P=raw)(?=[\s/>])[^>]*>|\Z)"  # an unclosed one takes the rest, as in browsers
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<more>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_BLOCK = frozenset(
    "html head body main article section header footer nav aside form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th"
    " caption blockquote pre figure figcaption address details summary dialog fieldset legend select option button menu center hgroup search".split()
)
_BREAK = frozenset(("br", "hr"))
_VOID = frozenset("br hr img input meta link wbr source area base col embed track param".split())
#: What is in them is no text of the page, if they are closed at all.
_MUTE = frozenset("noscript template svg iframe object canvas video audio".split())
#: Tags that a new block of the kind ends when it is still open.
_ENDS_P = _BLOCK - {"html", "head", "body"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_BAD_TAG = frozenset("nav footer aside form menu button select fieldset dialog head search".split())
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
#: Parts of names that mark boilerplate, reader comments, the article, and parts that say nothing beside these.
_BAD_WORD = frozenset(
    "nav navbar navigation menu footer header sidebar aside widget ad ads advert advertisement adverts sponsor sponsored promo banner cookie cookies consent gdpr"
    " notice alert popup modal overlay newsletter subscribe subscription signup login related recommended recommendations share sharing social breadcrumb"
    " breadcrumbs pagination pager masthead skip toolbar copyright".split()
)
_READER = frozenset("comment comments commentlist disqus respond replies reply".split())
_GOOD_WORD = frozenset("article articlebody entry post story main maincontent content".split())
_PLAIN = frozenset("list box wrapper wrap container slot left right top bottom inner outer posts articles links link bar block area section site page user users reader readers item items text title form row col body unit global".split())
#: What an unmarked footer says; within an article it is text like any other.
_LEGAL = re.compile(r"©|\(c\)|copyright|all rights reserved|terms of (?:use|service)|privacy|cookies?\b|imprint|impressum|mentions légales|aviso legal", re.I)
_WRAPPER = frozenset(("html", "body"))
#: The classifier's features, each from 0 to 1, and their weights, as ``html_labels.fitted`` gives them.
FEATURES = (
    "bias", "in_article", "beside_article", "boilerplate_tag", "boilerplate_name", "article_name", "reader_comments", "hidden", "links", "length", "punctuation", "paragraph", "heading", "item", "legal", "end_of_page",
    "start_of_page", "depth", "alone",
)
WEIGHTS = (-0.25, 1.06, -2.66, -7.81, -8.71, 1.28, -11.02, -5.83, -6.78, 5.42, 0.61, 1.56, 2.57, 0.8, -5.78, -2.45, -1.21, 0.44, 0.99)
_NEAR, _SHARED, _SIBLING = 0.3, 0.9, 0.5


class _Element:
    """An open element: what it and those around it say of what is below; ``parent`` instead of a path."""

    __slots__ = ("tag", "parent", "depth", "inside", "bad", "name", "good", "reader", "hidden", "mute", "inline")

    def __init__(self, tag: str, attributes: str, parent: _Element | None, inline: bool = False):
        self.tag, self.parent, self.inline = tag, parent, inline
        self.depth = parent.depth + 1 if parent else 0
        self.inside = bool(parent and parent.inside)
        self.bad = tag in _BAD_TAG or tag == "header" and not self.inside
        self.name = self.good = self.reader = 0.0
        self.hidden, self.mute = False, tag in _MUTE
        if attributes and not attributes.isspace():
            self._read(attributes)
        if tag in ("article", "main"):
            self.inside = True
        elif parent:
            self.bad |= parent.bad
            self.name = max(self.name, parent.name)
        if parent:
            self.good, self.reader = max(self.good, parent.good), max(self.reader, parent.reader)
            self.hidden |= parent.hidden
            self.mute |= parent.mute

    def _read(self, attributes: str) -> None:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                for one in value.split() if self.tag not in _WRAPPER else ():
                    parts = [p.lower() for p in _PART.findall(one)]
                    share = lambda own: sum(p in own or p in _PLAIN for p in parts) / len(parts) if any(p in own for p in parts) else 0.0  # noqa: B023, E731
                    self.name, self.reader = max(self.name, share(_BAD_WORD)), max(self.reader, share(_READER))
                    self.good = max(self.good, share(_GOOD_WORD))
            elif name == "role":
                self.bad |= value.lower() in _BAD_ROLE
                self.inside |= value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
                self.hidden = True

    def says(self) -> bool:
        return self.bad or self.hidden or self.name > 0 or self.reader > 0


class Block:
    """Text pieces in page order (a number stands for the inline block of that index), with what is around them."""

    __slots__ = ("parts", "text", "element", "links", "within")

    def __init__(self, parts: list, element: _Element, linked: int):
        self.parts, self.element, self.within = parts, element, -1
        self.text = _clean("".join(p for p in parts if isinstance(p, str)))
        self.links = min(1.0, linked / max(1, len(self.text)))


def _clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in the order in which they end."""
    out: list[Block] = []
    stack, opened = [_Element("", "", None)], Counter()
    solid: list[_Element] = [stack[0]]  # open elements that are not inline
    inlines: list[_Element] = []
    buffers: list[list] = [[[], 0]]  # of the block, then of each open inline element: parts, linked characters
    in_link = False
    lower = page.lower()
    last_close = {t: lower.rfind("</" + t) for t in _MUTE}

    def flush() -> None:
        owners = [solid[-1], *inlines]
        for i in range(len(buffers) - 1, -1, -1):
            parts, linked = buffers[i]
            if not parts:
                continue
            block = Block(parts, owners[i], linked)
            if block.text:
                for p in parts:
                    if isinstance(p, int):
                        out[p].within = len(out)
                out.append(block)
                if i:
                    buffers[i - 1][0].append(len(out) - 1)
            buffers[i] = [[], 0]

    def text_of(a: int, b: int) -> None:
        if b > a and not stack[-1].mute:
            buffers[-1][0].append(page[a:b])
            buffers[-1][1] += (b - a) * in_link

    def close(tag: str) -> None:
        """Pops up to the last element of the tag; none is searched for that is not open."""
        while True:
            e = stack.pop()
            opened[e.tag] -= 1
            (inlines if e.inline else solid).pop()
            if e.inline:
                parts, linked = buffers.pop()
                block = Block(parts, e, linked)
                if block.text:
                    for p in parts:
                        if isinstance(p, int):
                            out[p].within = len(out)
                    out.append(block)
                    buffers[-1][0].append(len(out) - 1)
            if e.tag == tag:
                return

    at, rest = 0, page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, rest):
        text_of(at, m.start())
        at = m.end()
        if m["raw"] and not m["closed"] or m["ends"] == "":
            at = rest = len(page)
            break
        if m["tag"] is None:
            continue
        tag, more = m["tag"].lower(), m["more"]
        if tag == "a":
            in_link = not m["end"]
        if tag in _BREAK:
            buffers[-1][0].append(" ")
        if tag not in _BLOCK:
            if m["end"]:
                if opened[tag]:
                    close(tag)
            elif tag in _MUTE:
                if not more.endswith("/") and last_close[tag] >= at:
                    stack.append(_Element(tag, more, stack[-1]))
                    solid.append(stack[-1])
                    opened[tag] += 1
            elif tag not in _VOID and more and not more.isspace() and not more.endswith("/"):
                e = _Element(tag, more, stack[-1], inline=True)
                if e.says() and not stack[-1].says():
                    stack.append(e)
                    inlines.append(e)
                    opened[tag] += 1
                    buffers.append([[], 0])
            continue
        if stack[-1].mute:
            if not m["end"]:
                continue
            if not opened[tag]:
                continue
        flush()
        in_link = False
        if m["end"]:
            if opened[tag]:
                close(tag)
            continue
        closes = _SAME.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        if tag == "body":
            closes = {"head"}
        while len(stack) > 1 and stack[-1].tag in closes:
            close(stack[-1].tag)
        stack.append(_Element(tag, more, stack[-1]))
        solid.append(stack[-1])
        opened[tag] += 1
    if at < len(page):
        broken = re.search(r"<[a-zA-Z/!?]", page[max(at, rest) :])  # a tag that never ends
        text_of(at, max(at, rest) + broken.start() if broken else len(page))
    flush()
    return out


def features(rows: list[Block]) -> list[tuple[float, ...]]:
    """What the classifier sees of each block."""
    marked = any(r.element.inside for r in rows)
    out = []
    for i, r in enumerate(rows):
        e, n = r.element, len(rows)
        words = r.text.count(" ") + 1
        stops = sum(r.text.count(c) for c in ".,;:!?") / words
        out.append(
            (
                1.0, float(e.inside), float(marked and not e.inside), float(e.bad), e.name, e.good, e.reader, float(e.hidden), r.links, min(1.0, log2(1 + len(r.text)) / 10), min(1.0, 5 * stops), float(e.tag in ("p", "blockquote", "pre")),
                float(e.tag in ("h1", "h2", "h3", "h4")), float(e.tag in ("li", "td", "th", "dd", "dt", "option")), float(not e.inside and len(r.text) < 400 and _LEGAL.search(r.text) is not None), float(not e.inside and i >= n - 2 and n > 4), float(not e.inside and i < 2 and n > 4),
                min(1.0, e.depth / 20), float(n == 1),
            )
        )
    return out


def costs(rows: list[Block]) -> list[float]:
    """Log-odds of content of each block."""
    return [sum(w * x for w, x in zip(WEIGHTS, f, strict=True)) for f in features(rows)]


def ties(rows: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, and the last block before under the same parent."""
    out, last = [], {}
    for i, r in enumerate(rows):
        if i:
            x, y = rows[i - 1].element, r.element
            deepest = max(x.depth, y.depth) + 1
            while x is not y:  # elements that end are never met again, so all these climbs together are as long as the page has elements
                if x.depth >= y.depth:
                    x, y = x.parent, y
                else:
                    y = y.parent
            out.append((i - 1, i, _NEAR + _SHARED * (x.depth + 1) / deepest))
        parent = id(r.element.parent or r.element)
        if last.get(parent, i - 1) != i - 1:
            out.append((last[parent], i, _SIBLING))
        last[parent] = i
    return out


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node pays ``|terminal|`` for a label against its sign, an edge its capacity if its ends differ."""
    n = len(terminal)
    cost, near = list(terminal), [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(cost[i]) >= sum(near[i].values()):
            label[i] = cost[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                cost[j] += c if label[i] else -c
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _dinic(rest, cost, near), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _dinic(rest: list[int], cost: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Whether each node stays on the source's side after a maximum flow."""
    index = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in rest:
        if cost[i] > 0:
            edge(source, index[i], cost[i], 0.0)
        elif cost[i] < 0:
            edge(index[i], sink, -cost[i], 0.0)
        for j, c in near[i].items():
            if j > i:
                edge(index[i], index[j], c, c)
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-12 and to[e] not in level:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if sink not in level:
            return [k in level for k in range(len(rest))]
        at = [0] * len(out)
        path: list[int] = []
        here = source
        while True:
            if here == sink:
                most = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= most
                    cap[e ^ 1] += most
                cut = next(k for k, e in enumerate(path) if cap[e] <= 1e-12)
                here = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[here] < len(out[here]):
                e = out[here][at[here]]
                if cap[e] > 1e-12 and level.get(to[e]) == level[here] + 1:
                    break
                at[here] += 1
            if at[here] < len(out[here]):
                path.append(out[here][at[here]])
                here = to[path[-1]]
            elif path:
                here = to[path.pop() ^ 1]
                at[here] += 1
            else:
                break


def main_text(page: str | None) -> str:
    if not page:
        return ""
    rows = blocks(page)
    kept = minimum_cut(costs(rows), ties(rows))
    texts: list[str] = []
    for r, keep in zip(rows, kept, strict=True):  # inline blocks come before the block that they stand in
        whole = "".join(p if isinstance(p, str) else texts[p] for p in r.parts) if keep else ""
        texts.append(whole)
    return " ".join(filter(None, (_clean(t) for r, t, keep in zip(rows, texts, kept, strict=True) if keep and (r.within < 0 or not kept[r.within]))))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column("html")]
        n = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), n], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (empty if there is none) and n_chars, its code points."""
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
