"""Main text of web pages by gradient-boosted trees over DOM nodes.

A tolerant parser builds the element tree of a page. Every element is described by its tag, hashed
attribute tokens, depth, siblings, and the density of text and links in its subtree. Boosted trees
give the log odds that the element belongs to (or holds) the article. Decoding is hierarchical: an
element can only be kept if its parent is, and among all such choices the one with the largest sum
of log odds is taken, by one pass up and one down the tree. Text of kept elements is put out by
blocks, in page order.

Text that stands beside blocks (under body, a wrapper, the article) is a node of its own, with the
plain inline elements in it, and so are menus of bare links; they are judged like elements. Inline
elements with a name (class, id, role, ...) are judged too. Only inside a text block (p, li, h1 to h6,
td, blockquote, ... without other blocks) inline elements go with it, and the text of an element
without blocks goes with that element.

The trees are fitted on a bounded sample: at most ``PAGES`` pages with an article element, those with the
smallest hash of page_id. Their paragraphs are also set anew into generated layouts (other wrappers,
menus, notices, adverts, forms, comments, ...), so that the model learns such parts even where the
sample has none. The fit runs on the driver; all pages are read whole, in one pass without a shuffle.

Tags are read as browsers read them (a quote counts only behind an equals sign), in time proportional to
the page; ``noscript`` is an element like others. Features are laid out in full for ``NODES`` nodes at a
time, so memory follows the longest page's text and tree alone. A column of the input named like the
new one is replaced.

Null and empty pages give an empty text. Repeated rows are each extracted. White space is what
``str.split`` splits at; a line break element counts as white space.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table, with_rows

PAGES = 200
TREES, DEPTH, RATE = 60, 4, 0.3
TOKEN_BUCKETS = 256
# Nodes described in full at a time.
NODES = 1 << 13

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe", "template", "svg", "select", "head")
INLINE = set(
    "a abbr b bdi bdo cite code del dfn em font i ins kbd label mark q s samp small span strong sub sup "
    "time tt u var big strike acronym br wbr img".split()
)
# Blocks whose inline elements go with them, and the blocks that may stand in them.
TEXT_BLOCKS = set("p li h1 h2 h3 h4 h5 h6 td th blockquote pre dt dd figcaption caption address summary".split())
LISTS = set("ul ol dl".split())
# The node of a run of text.
TEXT = "#text"
# Attributes that name an element.
NAMING = ("class", "id", "role", "aria-label", "itemprop")
# Elements that end an open paragraph.
BREAKS_P = set(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# Elements that end an open one of the same kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"table", "ul", "ol", "dl", "div", "article", "section", "main", "aside", "body", "td", "nav", "form"}
TAGS = (
    "html body div article main section aside nav header footer form p h1 h2 h3 h4 h5 h6 ul ol li table tr td "
    "th blockquote pre figure figcaption a span b button fieldset dl dt dd address details menu #text ins small label "
    "noscript code summary"
).split()

# One attribute. A quote counts only behind ``=``; one that never ends is a character like any other.
_VALUE = r"(?:\s*+=\s*+(?:\"({0})\"|'({1})'|([^\s>][^\s>]*+))?+)?+"
_NAME = r"[^\s/>][^\s/>=]*+"
_ATTR = re.compile(f"({_NAME})" + _VALUE.format("[^\"]*+", "[^']*+"))
_PLAIN = re.sub(r"\((?!\?)", "(?:", _VALUE.format("[^\"]*+", "[^']*+"))
# A tag from its name on; possessive throughout, so no character is looked at more than twice.
_TAG = re.compile(f"([a-zA-Z][^\\s/>]*+)((?:[\\s/]++|{_NAME}{_PLAIN})*+)(?:>|\\Z)")
_MARKUP = re.compile("<(?=[a-zA-Z/!?])")
# It may begin with the dashes that open the comment.
_COMMENT_END = re.compile("--!?>")
_PARTS = re.compile(r"[a-z]+")
_NAMED = re.compile(r"(?:^|[\s\"'])(?:" + "|".join(NAMING) + r")\s*=", re.I)
_BETWEEN_LINKS = re.compile(r"[\s|/·•»›>–-]*")
_END = {t: re.compile(f"</{t}\\s*>", re.I) for t in RAW}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attributes: str = ""
    parts: list = field(default_factory=list)  # texts and child numbers in page order
    judged: bool = True  # by its own odds; else it goes with its parent


def menus_apart(nodes: list[Node], flow: list) -> list[list]:
    """A run of text and inline elements, cut so that two or more links in a row are by themselves."""
    cuts, start, last, links = [0], None, 0, 0

    def end() -> None:
        if links > 1:
            cuts.extend((start, last))

    for k, part in enumerate(flow):
        if part.__class__ is not str and nodes[part].tag == "a":
            start, links = (start, links + 1) if links else (k, 1)
            last = k + 1
        elif part.__class__ is str and not _BETWEEN_LINKS.fullmatch(part):
            end()
            links = 0
        elif part.__class__ is not str and nodes[part].tag not in ("br", "wbr"):
            end()
            links = 0
    end()
    cuts.append(len(flow))
    return [flow[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def with_runs(nodes: list[Node]) -> list[Node]:
    """The tree with a node for every run of text that is judged by itself (still in page order)."""
    n = len(nodes)
    flat, texty, named = [True] * n, [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        if nodes[i].tag not in INLINE or not flat[i]:
            flat[nodes[i].parent] = False
    for i in range(1, n):
        node = nodes[i]
        if node.tag in INLINE:
            texty[i] = texty[node.parent]
            named[i] = "=" in node.attributes and _NAMED.search(node.attributes) is not None
        elif node.tag in TEXT_BLOCKS:
            texty[i] = flat[i] or not any(
                p.__class__ is int and nodes[p].tag not in INLINE and nodes[p].tag not in LISTS for p in node.parts
            )

    def runs(i: int) -> list:
        found, flow = [], []
        whole = flat[i]

        def close() -> None:
            pieces = menus_apart(nodes, flow)
            for piece in pieces:
                links = sum(p.__class__ is int and nodes[p].tag == "a" for p in piece)
                blank = all(p.__class__ is str and p.isspace() for p in piece)
                if blank or (whole and (links < 2 or len(pieces) == 1 or not apart(piece))):
                    found.extend(piece)
                else:
                    solid = [p for p in piece if p.__class__ is int or not p.isspace()]
                    # An element by itself is judged as such.
                    found.append((solid[0],) if len(solid) == 1 and solid[0].__class__ is int else piece)
            flow.clear()

        for part in nodes[i].parts:
            if part.__class__ is str or (nodes[part].tag in INLINE and flat[part] and not named[part]):
                flow.append(part)
            else:
                close()
                found.append(part)
        close()
        return found

    def apart(piece: list) -> bool:
        """Whether nothing but links and what parts them is in it."""
        return all(
            _BETWEEN_LINKS.fullmatch(p) if p.__class__ is str else nodes[p].tag in ("a", "br", "wbr") for p in piece
        )

    made: list[Node] = []
    work: list = [(0, 0, False)]
    while work:
        item, up, inside = work.pop()
        if item.__class__ is str:
            made[up].parts.append(item)
            continue
        depth = made[up].depth + 1 if made else 0
        if item.__class__ is list:
            node, parts, inside = Node(TEXT, up, depth), item, True
        elif item.__class__ is tuple:
            old = nodes[item[0]]
            node, parts, inside = Node(old.tag, up, depth, old.attributes), old.parts, True
        else:
            old = nodes[item]
            inline = old.tag in INLINE
            inside = texty[item] or (inside and inline)
            plain = inline and flat[item] and not named[item]
            node = Node(old.tag, up, depth, old.attributes, judged=not (inline and (inside or plain)))
            parts = old.parts if inside or plain else runs(item)
        me = len(made)
        if made:
            made[up].parts.append(me)
        made.append(node)
        work.extend((p, me, inside) for p in reversed(parts))
    return made


def parse(page: str) -> list[Node]:
    """Elements and runs of text in page order; node 0 is the root."""
    return with_runs(elements(page))


class Open:
    """The open elements of a page, with the places of each kind, so that no step walks the stack."""

    def __init__(self, root: int) -> None:
        self.stack, self.tags = [root], [""]
        self.places: dict[str, list[int]] = {}
        self.blocks, self.scopes, self.walls = [0], [0], [0]

    def push(self, node: int, tag: str) -> None:
        here = len(self.stack)
        self.stack.append(node)
        self.tags.append(tag)
        self.places.setdefault(tag, []).append(here)
        if tag not in INLINE:
            self.blocks.append(here)
        if tag in SCOPE:
            self.scopes.append(here)
            if tag != "td":
                self.walls.append(here)

    def last(self, tag: str) -> int:
        """Place of the innermost open element of this kind; 0 if none is open."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        for tag in self.tags[place:]:
            self.places[tag].pop()
        del self.stack[place:], self.tags[place:]
        for places in (self.blocks, self.scopes, self.walls):
            while places[-1] >= place:
                places.pop()


def elements(page: str) -> list[Node]:
    """Elements in page order; node 0 is the root. Time grows in proportion to the page.

    A tag without its end takes the rest of the page, as in browsers.
    """
    nodes = [Node("#", 0, 0)]
    now = Open(0)
    at, head = 0, False

    def text(piece: str) -> None:
        if piece:
            nodes[now.stack[-1]].parts.append(html.unescape(piece) if "&" in piece else piece)

    while True:
        found = _MARKUP.search(page, at)
        if not found:
            text(page[at:])
            return nodes
        text(page[at : found.start()])
        at = found.end()
        if page.startswith("!--", at):
            stop = _COMMENT_END.search(page, at + 1)
            at = stop.end() if stop else len(page)
            continue
        ending = page[at] == "/"
        tag = _TAG.match(page, at + ending)
        if not tag:  # a declaration, or an end tag without a name
            at = page.find(">", at) + 1 or len(page)
            continue
        at = tag.end()
        name, rest = tag.group(1).lower(), tag.group(2)
        if page[at - 1] != ">":
            return nodes
        if ending:
            keep = now.last(name)
            # An inline end tag does not close the blocks opened inside it.
            if keep and not (name in INLINE and now.blocks[-1] > keep):
                now.cut(keep)
            elif not keep and name in ("p", "br"):
                text(" ")
            continue
        if name in BREAKS_P and (place := now.last("p")) and now.scopes[-1] <= place:
            now.cut(place)
        if name in ENDS and (place := max(map(now.last, ENDS[name]))) and now.walls[-1] <= place:
            now.cut(place)
        if name in RAW:
            if name == "head":
                stop = None if head else re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
                at = (stop.end() if stop.group().startswith("</") else stop.start()) if stop else at
                head = True
            elif not rest.endswith("/"):
                stop = _END[name].search(page, at)
                at = stop.end() if stop else len(page)
            continue
        node = Node(name, now.stack[-1], len(now.stack), rest)
        nodes[now.stack[-1]].parts.append(len(nodes))
        nodes.append(node)
        if name not in VOID and not rest.endswith("/"):
            now.push(len(nodes) - 1, name)


_TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
_NUMBERS = 21
FEATURES = _NUMBERS + len(TAGS) + TOKEN_BUCKETS


def bucket(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode()) % TOKEN_BUCKETS


def in_line(nodes: list[Node], node: Node, back: bool = False) -> list[tuple]:
    """(part, neighbour) for the judged inline parts of a node with text or an inline element right
    behind them (before them if ``back``) on the same line."""
    parts = [p for p in node.parts if p.__class__ is int or not p.isspace()]
    if len(parts) < 2:
        return []
    inline = [p.__class__ is str or nodes[p].tag == TEXT or nodes[p].tag in INLINE and nodes[p].tag != "br" for p in parts]

    def broken(p, last: bool) -> bool:
        """Whether a run of text begins (ends) with a line break."""
        if p.__class__ is str or nodes[p].tag != TEXT:
            return False
        solid = [q for q in nodes[p].parts if q.__class__ is int or not q.isspace()]
        return solid[-last].__class__ is int and nodes[solid[-last]].tag == "br"

    found = []
    for k in range(len(parts) - 1):
        if inline[k] and inline[k + 1] and not broken(parts[k], True) and not broken(parts[k + 1], False):
            a, b = (parts[k + 1], parts[k]) if back else (parts[k], parts[k + 1])
            if a.__class__ is int and nodes[a].judged:
                found.append((a, b))
    return found


@dataclass
class Described:
    """Features of nodes: a few numbers each, and which of the yes-or-no features they have."""

    numbers: np.ndarray
    row: np.ndarray
    column: np.ndarray

    def dense(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """One row of all features per node from ``start`` to ``stop``."""
        numbers = self.numbers[start:stop]
        rows = np.zeros((len(numbers), FEATURES), np.float32)
        rows[:, :_NUMBERS] = numbers
        a, b = np.searchsorted(self.row, (start, start + len(numbers)))
        rows[self.row[a:b] - start, self.column[a:b]] = 1
        return rows


def describe(nodes: list[Node]) -> Described:
    """Features of every node."""
    n = len(nodes)
    marked: list[tuple[int, int]] = []
    chars, linked, tags, stops, blocks = ([0] * n for _ in range(5))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        for part in node.parts:
            if part.__class__ is str:
                chars[i] += len(part) - part.count(" ")
                stops[i] += part.count(".") + part.count(",")
        tags[i] += 1
        blocks[i] += node.tag in ("p", "li", "td")
        if node.tag == "a":
            linked[i] = chars[i]
        if i:
            for total in (chars, linked, tags, stops, blocks):
                total[node.parent] += total[i]
    children = [[p for p in node.parts if p.__class__ is int] for node in nodes]
    place, paragraphs, within = [0] * n, [0] * n, [0] * n
    kinds: list[dict[str, int]] = [{}] * n
    for i, own in enumerate(children):
        count: dict[str, int] = {}
        for k, j in enumerate(own):
            place[j] = k
            tag = nodes[j].tag
            count[tag] = count.get(tag, 0) + 1
            within[j] = 1 if nodes[i].tag in ("article", "main") else within[i]
        kinds[i] = count
        paragraphs[i] = count.get("p", 0)
    before, after = [0] * n, [0] * n
    for node in nodes:
        for a, b in in_line(nodes, node):
            after[a] = len(b) - b.count(" ") if b.__class__ is str else chars[b]
        for b, a in in_line(nodes, node, True):
            before[b] = len(a) - a.count(" ") if a.__class__ is str else chars[a]
    numbers = []
    for i, node in enumerate(nodes):
        up = node.parent
        same = children[up] if i else (0,)
        own = sum(len(p) for p in node.parts if p.__class__ is str and not p.isspace())
        numbers.append(
            (
                node.depth, len(children[i]), place[i], len(same) - place[i] - 1, kinds[up].get(node.tag, 1), own,
                chars[i], linked[i] / (chars[i] + 1), chars[i] / tags[i], stops[i] / (chars[i] + 1) * 100, blocks[i],
                chars[i] / (chars[0] + 1), chars[up], linked[up] / (chars[up] + 1), paragraphs[up],
                _TAG_NUMBER.get(nodes[up].tag, -1), chars[same[place[i] - 1]] if place[i] else 0, within[i],
                paragraphs[i], before[i], after[i],
            )
        )
        if node.tag in _TAG_NUMBER:
            marked.append((i, _NUMBERS + _TAG_NUMBER[node.tag]))
        if "=" in node.attributes:
            for name, *values in _ATTR.findall(node.attributes.lower()):
                if name in NAMING:
                    for token in _PARTS.findall("".join(values)):
                        marked.append((i, _NUMBERS + len(TAGS) + bucket(token)))
    row, column = np.array(marked, np.int64).reshape(-1, 2).T
    return Described(np.array(numbers, np.float32), row, column)


@dataclass
class Trees:
    """Complete trees as arrays: feature and threshold of inner nodes, value of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def odds(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.full(len(rows), self.base), np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (rows[every, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return total


def judge(trees: list[list[Node]], model: Trees) -> list[np.ndarray]:
    """Odds of the nodes of each tree; ``NODES`` of them at a time are laid out in full."""
    made = [describe(nodes) for nodes in trees]
    counts = np.cumsum([0, *map(len, trees)])
    whole = Described(
        np.concatenate([m.numbers for m in made]),
        np.concatenate([m.row + c for m, c in zip(made, counts)]),
        np.concatenate([m.column for m in made]),
    )
    odds = [model.odds(whole.dense(a, a + NODES)) for a in range(0, int(counts[-1]), NODES)]
    return np.split(np.concatenate(odds), counts[1:-1])


def boost(rows: np.ndarray, wanted: np.ndarray, trees: int = TREES) -> Trees:
    """Fit by second-order boosting of the logistic loss on binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 25)[1:-1])) for c in rows.T]
    used = [f for f, e in enumerate(edges) if len(e) and rows[:, f].min() < rows[:, f].max()]
    edges = [e if (rows[:, f] > e[0]).any() else np.array([rows[:, f].min()]) for f, e in enumerate(edges)]
    binned = [np.searchsorted(edges[f], rows[:, f], side="left") for f in used]
    share = min(max(wanted.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(rows), base)
    inner = 2**DEPTH - 1
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - wanted, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        leaf = np.zeros(inner + 1)
        at = np.zeros(len(rows), np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = (1e-3, None, None)
            if len(mine) > 20:
                sum_g, sum_h = g[mine].sum(), h[mine].sum()
                for f, bins in zip(used, binned):
                    b, size = bins[mine], len(edges[f]) + 1
                    left_g = np.cumsum(np.bincount(b, g[mine], size))[:-1]
                    left_h = np.cumsum(np.bincount(b, h[mine], size))[:-1]
                    gain = left_g**2 / (left_h + 1) + (sum_g - left_g) ** 2 / (sum_h - left_h + 1)
                    k = int(gain.argmax())
                    if gain[k] - sum_g**2 / (sum_h + 1) > best[0]:
                        best = (gain[k] - sum_g**2 / (sum_h + 1), f, k)
            if best[1] is not None:
                feature[node], threshold[node] = best[1], edges[best[1]][best[2]]
            at[mine] = 2 * node + 1 + (rows[mine, feature[node]] > threshold[node])
        for k in range(inner + 1):
            mine = at == inner + k
            leaf[k] = -RATE * g[mine].sum() / (h[mine].sum() + 1)
        total += leaf[at - inner]
        made.append((feature, threshold, leaf))
    return Trees(*(np.array(x) for x in zip(*made)), base)


def subtree(nodes: list[Node], i: int) -> list[int]:
    found = [i]
    for k in found:
        found += [p for p in nodes[k].parts if p.__class__ is int]
    return found


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The consistent choice of elements (none without its parent) with the largest sum of odds."""
    best = np.clip(odds, -8, 8).astype(float)
    # Bare elements of one kind beside each other are judged together.
    alike: dict[tuple[int, str], list[int]] = {}
    for i, node in enumerate(nodes):
        if i and node.tag not in INLINE and node.tag != TEXT and "=" not in node.attributes:
            alike.setdefault((node.parent, node.tag), []).append(i)
    for group in alike.values():
        if len(group) > 1 and nodes[group[0]].tag != "div":
            best[group] = best[group].mean()
    # So are runs of text on one line with an inline element between them, by their length.
    for node in nodes:
        if sum(p.__class__ is int and nodes[p].tag == TEXT for p in node.parts) > 1:
            line: list[int] = []
            joined = {a: b for a, b in in_line(nodes, node) if b.__class__ is int}
            for part in [*node.parts, None]:
                if part.__class__ is int and nodes[part].tag == TEXT:
                    line.append(part)
                if part is None or (part.__class__ is int and part not in joined):
                    if len(line) > 1:
                        size = [sum(len(p) for k in subtree(nodes, i) for p in nodes[k].parts if p.__class__ is str) for i in line]
                        best[line] = np.average(best[line], weights=size)
                    line = []
    best[0] = max(best[0], 0)
    best[[not node.judged for node in nodes]] = 0
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and (not nodes[i].judged or best[i] > 0)
    return kept


def blocks_of(nodes: list[Node], kept: np.ndarray) -> list[str]:
    """Text of kept elements by blocks, white space as one space."""
    found: list[str] = []
    now: list[str] = []

    def close() -> None:
        if text := " ".join("".join(now).split()):
            found.append(text)
        now.clear()

    work: list = [0]
    while work:
        item = work.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            now.append(item)
        elif kept[item]:
            node = nodes[item]
            if node.tag == "br":
                now.append(" ")
            elif node.tag in INLINE or node.tag == TEXT:
                work.extend(reversed(node.parts))
            else:
                close()
                work.append(None)
                work.extend(reversed(node.parts))
        elif nodes[item].tag not in INLINE and nodes[item].tag != TEXT:
            close()
        else:
            now.append(" ")
    close()
    return found


# Stands before bare article text of a layout.
MARK = "\ue000"
# Layouts for training: words that name parts of pages, and elements that hold them.
MAIN_NAMES = (
    "article post content entry story text body main page single news blog post-content entry-content "
    "article-body story-body main-content page-content post-body article-text richtext"
).split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs links pagination pager".split(),
    "header": "header site-header masthead branding top topbar logo page-header".split(),
    "footer": "footer site-footer bottom copyright legal page-footer colophon".split(),
    "aside": "sidebar side aside widget related recommended popular trending rail secondary more-stories".split(),
    "ad": "ad ads advert advertisement banner sponsor sponsored promo adsense ad-box".split(),
    "notice": (
        "cookie cookies consent notice gdpr popup modal alert newsletter subscribe signup banner-notice "
        "cookie-notice cookie-banner paywall"
    ).split(),
    "form": "search login form contact-form signup-form search-form subscribe-form".split(),
    "comments": (
        "comments comment comment-list reader-comments discussion responses replies disqus comment-body user-comments"
    ).split(),
    "share": "share social sharing follow tags meta byline author-box".split(),
}
HOLDERS = {
    "nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"),
    "ad": ("div", "aside", "section", "ins", "ins", "span"), "notice": ("div", "section", "aside", "p"), "form": ("form",),
    "comments": ("section", "div", "ol", "aside"), "share": ("div", "ul", "span"),
}


def layout(rnd: random.Random, title: str, texts: list[str], other: list[str]) -> str:
    """A page around the given article texts; elements of the article carry ``data-y``, bare text ``MARK``."""
    esc = html.escape

    def names(options: list[str]) -> str:
        kind = rnd.random()
        return "" if kind < 0.15 else f' {rnd.choice(["class", "class", "id"])}="{rnd.choice(options)}"'

    def few_words() -> str:
        return " ".join(rnd.choice(other).split()[: rnd.randint(1, 6)])

    def links() -> str:
        return rnd.choice([" ", "", " | ", "\n"]).join(
            f'<a href="/x">{esc(few_words())}</a>' for _ in range(rnd.randint(2, 7))
        )

    def bare() -> str:
        """Text or inline elements that stand by themselves and are not of the article."""
        kind, some_words = rnd.random(), esc(rnd.choice(other) if rnd.random() < 0.15 else few_words())
        if kind < 0.3:
            return rnd.choice(["{}", "{}", "&copy; 2020 {}", "Copyright 2021 {}", "{}. All rights reserved.", "Skip to {}"]).format(some_words)
        if kind < 0.55:
            return links()
        if kind < 0.7:
            tag = rnd.choice(["small", "label", "span", "a", "em", "b", "cite"])
            return f"<{tag}{names(sum(OTHER_NAMES.values(), []))}>{some_words}</{tag}>"
        return inline_part(rnd.choice(["ad", "ad", "share", "share", "nav", "footer", "header", "aside"]))

    def inline_part(kind: str) -> str:
        tag = rnd.choice(["ins", "span", "span", "a", "small"] if kind != "ad" else ["ins", "ins", "span", "a"])
        inner = links() if tag != "a" and rnd.random() < 0.3 else esc(rnd.choice(other) if rnd.random() < 0.3 else few_words())
        return f'<{tag} {rnd.choice(["class", "class", "id"])}="{rnd.choice(OTHER_NAMES[kind])}">{inner}</{tag}>'

    def part(kind: str) -> str:
        tag = rnd.choice(HOLDERS[kind])
        if tag in ("ins", "span") and rnd.random() < 0.8:
            return inline_part(kind)
        if kind in ("nav", "share") or (kind in ("aside", "footer") and rnd.random() < 0.5):
            inner = "".join(f'<li><a href="/x">{esc(few_words())}</a></li>' for _ in range(rnd.randint(2, 9)))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f"<label>{esc(few_words())}</label><input name=q><button>{esc(few_words())}</button><p>{esc(few_words())}</p>"
        elif kind == "comments":
            inner = "".join(
                f"<{t}{names(OTHER_NAMES[kind])}><p>{esc(rnd.choice(other))}</p></{t}>"
                for t in ["li" if tag == "ol" else rnd.choice(["div", "article", "p"])] * rnd.randint(1, 5)
            )
        elif kind == "header":
            inner = rnd.choice(["<h1>{}</h1>", "<a href='/'>{}</a>", "<div>{}</div>", "<p>{}</p>"]).format(esc(few_words()))
        else:
            inner = rnd.choice(["{}", "<p>{}</p>", "<h3>x</h3><p>{}</p>", "<div>{}</div>"]).format(
                esc(rnd.choice(other) if rnd.random() < 0.6 else few_words())
            )
        named = names(OTHER_NAMES[kind]) or (f' class="{rnd.choice(OTHER_NAMES[kind])}"' if tag in ("div", "section", "p", "ins") else "")
        return f"<{tag}{named}>{inner}</{tag}>"

    def some(kinds: str, most: int) -> str:
        made = [part(k) for k in rnd.sample(kinds.split(), rnd.randint(0, most))]
        if rnd.random() < 0.05:
            made.append(rnd.choice(["<noscript>{}</noscript>", "<noscript><p>{}</p></noscript>"]).format(esc(few_words())))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            made.insert(rnd.randint(0, len(made)), bare())
        return "".join(made)

    def phrase(text: str) -> str:
        """Article text with inline elements in it."""
        words = esc(text).split()
        for _ in range(rnd.choice([0, 1, 2, 3])):
            k, tag = rnd.randrange(len(words)), rnd.choice("a a b em span strong i".split())
            named = f' class="{rnd.choice("external ref lead highlight keyword term quote internal-link text bold".split())}"'
            words[k] = f'<{tag} data-y=1{named if rnd.random() < 0.5 else ""}>{words[k]}</{tag}>'
        return " ".join(w if w.startswith("<") else MARK + w for w in words)

    def rare_part(text: str) -> str:
        """An article part of a kind that sample pages may not have."""
        cells = [esc(t) for t in text.split(". ") if t]
        pairs = list(zip(cells[::2], cells[1::2])) or [(esc(few_words()), esc(text))]
        made = rnd.choice(
            [
                f"<pre>{esc(text)}</pre>",
                f"<pre>{esc(few_words())}</pre>",
                f"<pre><code>{esc(text)}</code></pre>",
                f"<noscript>{esc(text)}</noscript>",
                f"<noscript><p>{esc(text)}</p></noscript>",
                f"<noscript><p>{esc(few_words())}</p><p>{esc(text)}</p></noscript>",
                f"<noscript>{esc(few_words())}</noscript>",
                "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in pairs) + "</table>",
                f"<table><tr><th>{esc(few_words())}</th><th>x</th></tr><tr><td>{esc(few_words())}</td><td>7</td></tr></table>",
                "<dl>" + "".join(f"<dt>{a}</dt><dd>{b}</dd>" for a, b in pairs) + "</dl>",
                f"<figure><img src=x><figcaption>{esc(few_words())}</figcaption></figure>",
                "<ol>" + "".join(f"<li>{c}</li>" for c in cells or ["x"]) + "</ol>",
                f"<details><summary>{esc(few_words())}</summary><p>{esc(text)}</p></details>",
            ]
        )
        return re.sub("<([a-z]+)", r"<\1 data-y=1", made)

    pieces = [f'<h{(n := rnd.choice([1, 1, 2]))} data-y=1>{esc(title)}</h{n}>'] if rnd.random() < 0.9 else []
    if pieces and rnd.random() < 0.15:
        pieces = [f"<header data-y=1>{pieces[0]}</header>"]
    brief = rnd.random() < 0.2
    loose = rnd.random() < 0.2
    if loose:
        shown = [phrase(t) for t in texts if t.split()]
        if rnd.random() < 0.2:
            shown = [f'<span data-y=1 class="{rnd.choice(MAIN_NAMES)}">{t}</span>' for t in shown]
        for k, t in enumerate(shown):
            pieces.append(("<br><br>" if k else "") + t)
            if rnd.random() < 0.15:
                pieces.append(part(rnd.choice(["ad", "share", "notice", "aside"])) + rnd.choice(["", f"<p data-y=1>{esc(texts[0])}</p>"]))
    for text in () if loose else texts:
        text = " ".join(text.split()[: rnd.randint(1, 5)]) if brief else text
        kind = rnd.random()
        if kind < 0.08:
            rows = text.split(". ")
            pieces.append("<ul data-y=1>" + "".join(f"<li data-y=1>{esc(r)}</li>" for r in rows if r) + "</ul>")
        elif kind < 0.14:
            pieces.append(f"<blockquote data-y=1><p data-y=1>{esc(text)}</p></blockquote>")
        elif kind < 0.2:
            pieces.append(f"<h3 data-y=1>{esc(few_words())}</h3>")
        elif kind < 0.32:
            pieces.append(rare_part(text))
        else:
            pieces.append(f"<p data-y=1>{esc(text)}</p>")
        if rnd.random() < 0.12:
            pieces.append(part(rnd.choice(["ad", "share", "notice", "form", "aside"])))
        if rnd.random() < 0.06:
            pieces.append(bare())
    if not loose and rnd.random() < 0.1:
        pieces.insert(0, bare())
    if not loose and rnd.random() < 0.15:
        pieces.append(bare())
    body = "".join(pieces)
    if rnd.random() < 0.25:
        body += part("comments")
    for _ in range(rnd.choice([1, 1, 1, 2, 3])):
        tag = rnd.choice(["article", "article", "main", "div", "div", "section"])
        plain = tag in ("article", "main")
        named = names(MAIN_NAMES) if plain else (names(MAIN_NAMES) or ' class="row"')
        body = f"<{tag} data-y=1{named}>{body}</{tag}>"
        if rnd.random() < 0.3:
            body = some("aside ad share comments", 1) + body + some("aside ad share comments", 2)
    before = some("nav header ad notice form", 4)
    after = some("comments aside ad nav notice form share", 4)
    end = part("footer") if rnd.random() < 0.8 else ""
    return f"<html><head><title>x</title></head><body>{before}{body}{after}{end}</body></html>"


# Parts of a page that are not article text, wherever they stand.
_APART_TAGS = ("aside", "form", "nav")
_COMMENTS = set(OTHER_NAMES["comments"])
_APART = _COMMENTS | set(sum((OTHER_NAMES[k] for k in ("ad", "aside", "form", "nav", "share")), []))
_APART_PARTS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo sidebar related nav navbar navigation "
    "breadcrumb breadcrumbs pagination share sharing social comment comments disqus".split()
)


def names_of(node: Node) -> set[str]:
    if "=" not in node.attributes:
        return set()
    found = _ATTR.findall(node.attributes.lower())
    return {t for name, *values in found if name in ("class", "id", "role") for t in "".join(values).split()}


def article_nodes(nodes: list[Node]) -> np.ndarray:
    """Which nodes lie in an article of the page, less its adverts, asides, forms, menus, share boxes and comments.

    The article of a reader's comment is none.
    """
    inside, comment = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        if not i:
            continue
        names = names_of(node)
        parts = {p for t in names for p in _PARTS.findall(t)}
        page = node.tag in ("html", "body")
        comment[i] = not page and (comment[node.parent] or bool(names & _COMMENTS) or (node.tag == "article" and "comment" in parts))
        if comment[i]:
            continue
        if inside[node.parent]:
            inside[i] = not (node.tag in _APART_TAGS or names & _APART or parts & _APART_PARTS)
        else:
            # Below a part taken out of an article nothing is an article again.
            inside[i] = node.tag == "article" and not any(inside[k] for k in above(nodes, i))
    return inside


def above(nodes: list[Node], i: int) -> list[int]:
    found = []
    while i:
        i = nodes[i].parent
        found.append(i)
    return found


def labelled_nodes(nodes: list[Node], inside: str) -> np.ndarray:
    """1 for elements of the article and those around it; ``inside`` is how the article is known."""
    wanted = article_nodes(nodes).astype(float) if inside == "article" else np.zeros(len(nodes))
    for i, node in enumerate(nodes if inside != "article" else ()):
        if "data-y" in node.attributes or (
            node.tag == TEXT and any(p.__class__ is str and MARK in p for k in subtree(nodes, i) for p in nodes[k].parts)
        ):
            wanted[i] = 1
    for i in range(len(nodes) - 1, 0, -1):
        if wanted[i]:
            wanted[nodes[i].parent] = 1
    return wanted


def train(pages: list[str], seed: int = 11, layouts: int = 1200) -> Trees:
    """Fit on pages with an article element and on layouts made of their text."""
    rnd = random.Random(seed)
    rows, wanted, stories, other = [], [], [], ["more of this", "read on", "about us"]
    for page in pages:
        nodes = parse(page)
        y = labelled_nodes(nodes, "article")
        if not y.any():  # no article, or of comments only
            continue
        for i in range(1, len(nodes)):  # elements around the article go up to it only
            if nodes[i].tag == "article" and y[i]:
                texts = blocks_of(nodes, y > 0)
                stories.append(texts)
                break
        mine = [node.judged for node in nodes]
        rows.append(describe(nodes).dense()[mine])
        wanted.append(y[mine])
    stories = [s for s in stories if s] or [["a text of a few words.", "and one more."]]
    other += [t for s in stories for t in s[1:3]]
    for _ in range(layouts):
        title, *texts = rnd.choice(stories)
        start = rnd.randint(0, max(0, len(texts) - 1))
        nodes = parse(layout(rnd, title[:80], texts[start : start + rnd.randint(1, 12)] or [title], other))
        mine = [node.judged for node in nodes]
        wanted.append(labelled_nodes(nodes, "data-y")[mine])
        for node in nodes:
            node.attributes = node.attributes.replace("data-y=1", "")
            node.parts = [p.replace(MARK, "") if p.__class__ is str else p for p in node.parts]
        rows.append(describe(nodes).dense()[mine])
    return boost(np.concatenate(rows), np.concatenate(wanted))


def extract(page: str, model: Trees) -> str:
    nodes = parse(page)
    return "\n\n".join(blocks_of(nodes, decode(nodes, judge([nodes], model)[0])))


def extract_text(
    pages: DataFrame, column: str = "html", key: str = "page_id", sample: int = PAGES, model: Trees | None = None
) -> DataFrame:
    """``pages`` with ``text``, the main text of each page."""
    if model is None:
        chosen = (
            pages.where(F.lower(F.col(column)).contains("<article"))
            .select(F.xxhash64(key).alias("h"), key, column)
            .orderBy("h", key)
            .limit(sample)
        )
        model = train([r[2] for r in sorted(map(tuple, chosen.toLocalIterator()), key=lambda r: (r[0], str(r[1]), r[2]))])

    def make(columns: list[pa.Array]) -> list:
        texts: list[str] = []
        trees: list[list[Node]] = []

        def extract_all() -> None:
            for nodes, odds in zip(trees, judge(trees, model) if trees else ()):
                texts.append("\n\n".join(blocks_of(nodes, decode(nodes, odds))))
            trees.clear()

        for page in columns[0]:
            trees.append(parse(page.as_py() or ""))
            if sum(map(len, trees)) >= NODES:
                extract_all()
        extract_all()
        return [texts]

    return with_rows(pages, {"text": T.StringType()}, make, column)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
