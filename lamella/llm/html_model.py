"""Main text of web pages by a tree-structured graphical model.

Every element of the page is a node with a hidden label, content or not.  A
node's features (tag, class words, link density, text length) give its own
potential and each edge couples parent and child; messages passed once upward
and once downward give every node's exact marginal.  All potentials are
smoothed counts from labelled pages: pages that a seeded generator makes with
their labels, and all the pages themselves, labelled in part by what repeats
across them, by links and by long text; where that says nothing, the marginals
given the rest are the labels.
"""

from __future__ import annotations

import html
import random
import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, small_batches, stored, texts

#: A tag ends at the first > outside quoted values.  A quote that is never closed, or
#: whose value runs over a > into something that can't follow a value, is no quote.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^\"'>=]++|=\s*+(?>\"[^\">]*+\"|\"[^\"]*+\"(?=[\s/>])|'[^'>]*+'|'[^']*+'(?=[\s/>])|[^\s>\"'][^\s>]*+)?+|[\"'])*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
CUT_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<]*+)([^<]*+)")
REMARK = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/[^a-zA-Z>])[^>]*>", re.S)
#: Tags without a > outside quotes after which quotes are ignored: each costs a look at the rest of the page.
OPEN_QUOTES = 4
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
NAME_PART = re.compile(r"[a-z]+")
BLANK = re.compile(r"\s+")

# How HTML names its elements.
SKIPPED = frozenset("script style noscript template iframe svg title select datalist option textarea button canvas audio video noembed noframes".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
NESTED = frozenset("canvas audio video svg noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("object map math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mtable mtr mtd mfenced mstyle mpadded menclose merror mspace semantics annotation a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
P_ENDERS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    label: int = -1
    #: Text pieces and child numbers in page order.
    parts: list = field(default_factory=list)
    chars: int = 0
    linked: int = 0


def tokens(page: str) -> list[tuple]:
    """Text as (piece,) and tags as (closing, name, attributes) in page order.

    Every part of a page is read once: the time grows with its length whatever
    it holds.  Comments and the insides of raw-text elements are left out; a raw
    element without an end tag runs to the end of the page.
    """
    out: list[tuple] = []
    at, n, last, open_quotes = 0, len(page), page.rfind(">"), 0
    raw: dict[str, re.Pattern] = {}
    while at < n:
        start = page.find("<", at)
        if start < 0:
            out.append((page[at:],))
            break
        if page.startswith(("<!", "<?"), start) or page.startswith("</", start) and not page[start + 2 : start + 3].isalpha():
            m = REMARK.match(page, start) if start < last or page.startswith("<!--", start) else None
        elif not (page[start + 1 : start + 2].isalpha() and page[start + 1].isascii() or page[start + 1 : start + 2] == "/"):
            m = None
        elif start > last:
            m = CUT_TAG.match(page, start)
        else:
            m = TAG.match(page, start) if open_quotes < OPEN_QUOTES else PLAIN_TAG.match(page, start)
            if m is None:
                open_quotes += 1
                m = PLAIN_TAG.match(page, start)
        if m is None:
            out.append((page[at : start + 1],))
            at = start + 1
            continue
        if start > at:
            out.append((page[at:start],))
        at = m.end()
        if m.re is REMARK:
            continue
        tag = m[2].lower()
        if m.re is CUT_TAG:  # a tag that the page's end or the next tag cuts off
            continue
        if tag in RAW and not m[1]:
            if tag not in raw:
                raw[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I)
            if tag == "iframe" and m[3].endswith("/"):
                continue
            end = raw[tag].search(page, at)
            at = end.end() if end else n
            continue
        out.append((m[1], tag, m[3]))
    return out


def skips(found: list[tuple]) -> dict[int, int]:
    """Start of each skipped element that has an end tag, and where that is, as token numbers.

    A second start tag leaves the first open one without an end, except for tags that nest.
    """
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for k, t in enumerate(found):
        if len(t) == 1 or t[1] not in SKIPPED:
            continue
        stack = opened.setdefault(t[1], [])
        if t[0]:
            if stack:
                out[stack.pop()] = k
        elif not (t[1] == "svg" and t[2].endswith("/")):
            if t[1] not in NESTED:
                stack.clear()
            stack.append(k)
    return out


def parse(page: str) -> list[Node]:
    """Block elements in page order, the root first; inline tags melt into their block.

    Any text parses: stray end tags are ignored, open elements end with the
    page, a cut-off tag is dropped.  Skipped elements keep no text; of
    one without an end tag only the tag is skipped, unless it holds raw text.
    """
    nodes = [Node("#root", -1)]
    stack, links = [0], 0
    depth: Counter = Counter()  # how many elements of each tag are open
    found = tokens(page)
    ends = skips(found)

    def leave(k: int) -> None:
        for i in stack[k:]:
            depth[nodes[i].tag] -= 1
        del stack[k:]

    until = -1
    for number, token in enumerate(found):
        if number <= until:
            continue
        if len(token) == 1:
            piece = html.unescape(token[0]) if "&" in token[0] else token[0]
            node = nodes[stack[-1]]
            node.parts.append(piece)
            k = 0 if piece.isspace() else len(piece) - piece.count(" ")
            node.chars += k
            if links:
                node.linked += k
            continue
        closing, tag, attributes = token
        if closing:
            if tag == "a":
                links = 0
            elif tag == "br":
                nodes[stack[-1]].parts.append(" ")
            elif tag not in INLINE and depth[tag]:
                k = len(stack) - 1
                while nodes[stack[k]].tag != tag:
                    k -= 1
                leave(k)
                links = 0
            continue
        if tag in SKIPPED:
            until = ends.get(number, until)
            continue
        if tag == "br" or tag == "hr":
            nodes[stack[-1]].parts.append(" ")
            if tag == "br":
                continue
        if tag in VOID:
            continue
        if tag == "a":
            links = 1
            continue
        if tag in INLINE:
            continue
        enders = CLOSES.get(tag)
        if tag in P_ENDERS and nodes[stack[-1]].tag == "p":
            leave(len(stack) - 1)
            links = 0
        elif enders and nodes[stack[-1]].tag in enders:
            leave(len(stack) - 1)
            if tag == "tr" and nodes[stack[-1]].tag == "tr":
                leave(len(stack) - 1)
            links = 0
        names: tuple[str, ...] = ()
        if attributes:
            names = tuple(w for a in ATTRIBUTE.finditer(attributes) for w in NAME_PART.findall((a[1] or a[2] or a[3] or "").lower()))
        nodes.append(Node(tag, stack[-1], names))
        nodes[stack[-1]].parts.append(len(nodes) - 1)
        stack.append(len(nodes) - 1)
        depth[tag] += 1
    return nodes


@lru_cache(maxsize=1 << 14)
def feature_names(tag: str, own: bool, size: int, links: int, names: tuple[str, ...]) -> tuple[str, ...]:
    return (f"t:{tag}{'+' if own else ''}", f"s:{size}", f"l:{links}", *(f"n:{x}" for x in names))


def features(node: Node, whole: tuple[int, int]) -> tuple[str, ...]:
    """Of an element with ``whole`` = (characters, characters inside links) of its subtree."""
    chars, linked = whole
    share = linked / chars if chars else 0.0
    size = 0 if not chars else 1 if chars < 25 else 2 if chars < 120 else 3 if chars < 600 else 4
    own = node.chars > 0 and node.parent < 0  # bare text below no element at all
    return feature_names(node.tag, own, size, 0 if share < 0.1 else 1 if share < 0.5 else 2, node.names)


def totals(nodes: list[Node]) -> list[tuple[int, int]]:
    out = [[x.chars, x.linked] for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        out[p][0] += out[i][0]
        out[p][1] += out[i][1]
    return [(a, b) for a, b in out]


@dataclass
class Model:
    """Log potentials: ``own`` by feature (content minus not), ``edge`` by child tag as
    log P(child | parent) in rows (parent) of two.

    ``rest`` has the numbers (key, w) of features and, as "e:" and the tag, edges that
    are too many to hold; pages get theirs by a join.
    """

    own: dict[str, float]
    edge: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    prior: float
    rest: DataFrame | None = None

    def absent(self, nodes: list[Node]) -> set[str]:
        """What ``rest`` may know of a page."""
        keys = {f for x, w in zip(nodes, totals(nodes), strict=True) for f in features(x, w) if f not in self.own}
        return keys | {f"e:{x.tag}" for x in nodes if x.tag not in self.edge}

    def joined(self, found: dict[str, list[float]]) -> Model:
        """With what ``rest`` has for a page."""
        own = {k: w[0] for k, w in found.items() if len(w) == 1}
        edge = {k[2:]: ((w[0], w[1]), (w[2], w[3])) for k, w in found.items() if len(w) == 4}
        return Model(ChainMap(own, self.own), ChainMap(edge, self.edge), self.prior)

    def marginals(self, nodes: list[Node], evidence: np.ndarray | float = 0.0) -> np.ndarray:
        """P(content) of each node by sum-product: one pass up, one down.

        ``evidence`` adds to the nodes' log odds.
        """
        n = len(nodes)
        whole = totals(nodes)
        log_odds = np.array([sum(self.own.get(f, 0.0) for f in features(x, w)) for x, w in zip(nodes, whole, strict=True)])
        log_odds[0] += self.prior
        log_odds = log_odds + evidence
        up = np.empty((n, 2))
        up[:, 1] = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        up[:, 0] = 1 - up[:, 1]
        up = np.maximum(up, 1e-12).tolist()
        default = self.edge["*"]
        edges = [self.edge.get(x.tag, default) for x in nodes]
        message = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            e, (u0, u1) = edges[i], up[i]
            a, b = e[0][0] * u0 + e[0][1] * u1, e[1][0] * u0 + e[1][1] * u1
            s = a + b
            message[i] = (a / s, b / s)
            p = up[nodes[i].parent]
            x, y = p[0] * a / s, p[1] * b / s
            s = x + y
            up[nodes[i].parent] = [x / s, y / s]
        belief = [tuple(up[0])] * n
        for i in range(1, n):
            e, (b0, b1), (m0, m1) = edges[i], belief[nodes[i].parent], message[i]
            c0, c1 = b0 / m0, b1 / m1
            x = (e[0][0] * c0 + e[1][0] * c1) * up[i][0]
            y = (e[0][1] * c0 + e[1][1] * c1) * up[i][1]
            belief[i] = (x / (x + y), y / (x + y))
        return np.array([b[1] for b in belief])

    def extract(self, page: str) -> str:
        """Blocks of content in page order, one line each; "" if none."""
        nodes = parse(page)
        keep = self.marginals(nodes) > 0.5
        blocks: list[str] = []
        run: list[str] = []

        def flush() -> None:
            block = BLANK.sub(" ", "".join(run)).strip()
            if block:
                blocks.append(block)
            run.clear()

        stack = [(0, iter(nodes[0].parts))]
        while stack:
            i, parts = stack[-1]
            for part in parts:
                if isinstance(part, int):
                    flush()
                    stack.append((part, iter(nodes[part].parts)))
                    break
                if keep[i]:
                    run.append(part)
            else:
                flush()
                stack.pop()
        return "\n".join(blocks)


@dataclass
class Counts:
    """Weighted counts of labels, features and (parent, child) labels; add-one smoothing makes them a model."""

    own: tuple[Counter, Counter] = field(default_factory=lambda: (Counter(), Counter()))
    edge: dict[str, np.ndarray] = field(default_factory=dict)
    count: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def add(self, nodes: list[Node], content: np.ndarray) -> None:
        """A page whose node i is content with probability ``content[i]``."""
        p = content.tolist()
        for i, (x, w) in enumerate(zip(nodes, totals(nodes), strict=True)):
            own = (1 - p[i], p[i])
            self.count += own
            for f in set(features(x, w)):
                self.own[0][f] += own[0]
                self.own[1][f] += own[1]
            if x.parent >= 0:
                q = p[x.parent]
                for k in (x.tag, "*"):
                    if k not in self.edge:
                        self.edge[k] = np.zeros((2, 2))
                    self.edge[k] += [[(1 - q) * own[0], (1 - q) * own[1]], [q * own[0], q * own[1]]]

    def merge(self, other: Counts, weight: float = 1.0) -> None:
        for mine, its in zip(self.own, other.own, strict=True):
            for f, v in its.items():
                mine[f] += weight * v
        for k, v in other.edge.items():
            self.edge[k] = self.edge.get(k, 0) + weight * v
        self.count = self.count + weight * other.count

    def log_ratio(self, other: float, content: float) -> float:
        n = self.count + 1
        return float(np.log((content + 0.5) / (n[1] + 1)) - np.log((other + 0.5) / (n[0] + 1)))

    def model(self) -> Model:
        logs = {f: self.log_ratio(self.own[0][f], self.own[1][f]) for f in {*self.own[0], *self.own[1]}}
        edge = {"*": np.zeros((2, 2))} | self.edge
        return Model(logs, {k: transitions(c) for k, c in edge.items()}, 0.0)


def transitions(count: np.ndarray) -> tuple[tuple[float, float], tuple[float, float]]:
    return tuple(tuple(float(v) for v in r / r.sum()) for r in count + 1)


def train(pages: list[list[Node]]) -> Model:
    """From pages whose nodes carry labels 0 or 1."""
    counts = Counts()
    for nodes in pages:
        counts.add(nodes, np.array([x.label for x in nodes], float))
    return counts.model()


# Names that pages give to their parts, and the label each part has.
CONTENT_NAMES = "article content main post entry story body text".split()
OTHER_NAMES = "ad ads advert banner sponsor promo nav menu header footer sidebar aside comments comment reply cookie consent notice newsletter signup login form share social related widget breadcrumb pagination subscribe popup modal copyright".split()


def labelled_page(rng: random.Random) -> list[Node]:
    """A page made by rule, with its labels: the training data.

    Parts around the article are drawn with tags and names that pages use for
    them; texts are letters of drawn lengths, for only lengths and links count.
    """
    words = lambda n: " ".join("x" * rng.randint(1, 9) for _ in range(n))
    marks: list[int] = []
    out: list[str] = []

    def put(tag: str, label: int, name: str, inner) -> None:  # noqa: ANN001
        marks.append(label)
        shown = f' {rng.choice(["class", "id"])}="{name}"' if name else ""
        out.append(f"<{tag}{shown}>")
        inner() if callable(inner) else out.append(inner)
        out.append(f"</{tag}>")

    def links(label: int) -> None:
        def items() -> None:
            for _ in range(rng.randint(2, 8)):
                put("li", label, "", f'<a href="/">{words(rng.randint(1, 3))}</a>')

        if rng.random() < 0.6:
            put("ul", label, "", items)
        else:
            out.append(" ".join(f'<a href="/">{words(rng.randint(1, 3))}</a>' for _ in range(4)))

    def other() -> None:
        kind = rng.choice(["nav", "header", "footer", "aside", "form", "div", "div", "div", "section", "dialog"])
        name = rng.choice(OTHER_NAMES) if kind in ("div", "section") or rng.random() < 0.3 else ""

        def inner() -> None:
            r = rng.random()
            if r < 0.4:
                links(0)
            elif r < 0.7:
                out.append(words(rng.randint(2, 40)))
            else:
                for _ in range(rng.randint(1, 4)):
                    put(rng.choice(["p", "p", "p", "div", "h1", "h2", "h3", "h4"]), 0, "", words(rng.randint(2, 40)))

        put(kind, 0, name, inner)

    def article() -> None:
        def inner() -> None:
            if rng.random() < 0.8:
                put(rng.choice(["h1", "h1", "h2"]), 1, "", words(rng.randint(1, 14)))
            for _ in range(rng.randint(0, 14)):
                r = rng.random()
                if r < 0.75:
                    link = f' <a href="/">{words(2)}</a>' if rng.random() < 0.15 else ""
                    put("p", 1, "", words(rng.choice([1, 2, 5, 12, 30, 60, 120])) + link)
                elif r < 0.83:
                    put(rng.choice(["h2", "h3", "h4"]), 1, "", words(rng.randint(1, 8)))
                elif r < 0.9:
                    put(rng.choice(["ul", "ol"]), 1, "", lambda: [put("li", 1, "", words(rng.randint(1, 20))) for _ in range(rng.randint(1, 5))])
                elif r < 0.94:
                    put(rng.choice(["blockquote", "pre", "figure", "section", "div"]), 1, "", lambda: put("p", 1, "", words(rng.randint(3, 40))))
                elif r < 0.96:
                    put("table", 1, "", lambda: put("tr", 1, "", lambda: [put("td", 1, "", words(rng.randint(1, 6))) for _ in range(3)]))
                else:
                    other()

        r = rng.random()
        if r < 0.6:
            put(rng.choice(["article", "article", "main"]), 1, rng.choice(["", "", rng.choice(CONTENT_NAMES)]), inner)
        elif r < 0.9:
            put(rng.choice(["div", "section"]), 1, rng.choice(CONTENT_NAMES), inner)
        else:
            put("main", 1, "", lambda: put("article", 1, "", inner))

    def body() -> None:
        before, after = rng.randint(0, 4), rng.randint(0, 4)
        for _ in range(before):
            other()
        article()
        for _ in range(after):
            other()

    r = rng.random()
    if r < 0.1:  # bare text or paragraphs without a frame
        marks.append(1)
        if rng.random() < 0.5:
            out.append(words(rng.randint(1, 60)))
        else:
            for _ in range(rng.randint(1, 6)):
                put("p", 1, "", words(rng.randint(1, 60)))
    else:
        marks.append(0)
        put("html", 0, "", lambda: put("body", 0, "", body))
    nodes = parse("".join(out))
    for node, mark in zip(nodes, marks, strict=True):
        node.label = mark
    return nodes


GENERATED, SEED = 1500, 3


@lru_cache(maxsize=4)
def generated(n_pages: int = GENERATED, seed: int = SEED) -> Counts:
    rng, counts = random.Random(seed), Counts()
    for _ in range(n_pages):
        nodes = labelled_page(rng)
        counts.add(nodes, np.array([x.label for x in nodes], float))
    return counts


def default_model(n_pages: int = GENERATED, seed: int = SEED) -> Model:
    return generated(n_pages, seed).model()


#: Log odds that a sign of content or of its opposite adds.
SIGN = 3.0
LONG_TEXT = 120
#: A node in the sums over the table: whole numbers, for which no order of adding matters.
UNIT = 1 << 30
#: Different sums that a task holds at once.
MOST_SUMS = 50_000
#: Repeated blocks, and features and tags, that are broadcast; beyond, pages are joined with theirs.
MOST_BLOCKS, MOST_KEYS = 4_000_000, 200_000


def block_hashes(nodes: list[Node]) -> list[int]:
    """A hash of each node's own text, 0 if it has none."""
    import xxhash

    # a node without characters holds only blanks
    own = (" ".join("".join([p for p in x.parts if isinstance(p, str)]).split()) if x.chars else "" for x in nodes)
    return [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 if t else 0 for t in own]


def signs(nodes: list[Node], hashes: list[int], repeated: set[int]) -> np.ndarray:
    """What speaks for content (long text without links) and against it (text of other pages, links)."""
    out = np.zeros(len(nodes))
    for i, (x, h, (chars, linked)) in enumerate(zip(nodes, hashes, totals(nodes), strict=True)):
        if h in repeated or chars and linked > 0.5 * chars:
            out[i] = -SIGN
        elif x.chars >= LONG_TEXT and x.linked < 0.1 * x.chars:
            out[i] = SIGN
    return out


def among(hashes: list[int], ordered: np.ndarray) -> set[int]:
    """Those of ``hashes`` that ``ordered`` holds."""
    if not len(ordered):
        return set()
    found = np.array(hashes, np.int64)
    return set(found[ordered[np.minimum(np.searchsorted(ordered, found), len(ordered) - 1)] == found].tolist())


class Sums:
    """What :class:`Counts` counts, in whole numbers of 1 / UNIT and as rows (key, a, b, c, d):
    of a feature not and content, of "e:" and a tag, or * for all, the four of parent and child."""

    def __init__(self) -> None:
        self.own: dict[tuple[str, ...], list[int]] = {}
        self.edge: dict[str, list[int]] = {}

    def __len__(self) -> int:
        return len(self.own) + len(self.edge)

    def add(self, nodes: list[Node], content: np.ndarray) -> None:
        p = [round(x * UNIT) for x in content.tolist()]
        for x, w, one in zip(nodes, totals(nodes), p, strict=True):
            sums = self.own.setdefault(features(x, w), [0, 0])
            sums[0] += UNIT - one
            sums[1] += one
            if x.parent >= 0:
                above = p[x.parent]
                both = above * one // UNIT
                sums = self.edge.setdefault(x.tag, [0, 0, 0, 0])
                sums[0] += UNIT - above - one + both
                sums[1] += one - both
                sums[2] += above - both
                sums[3] += both

    def rows(self) -> pa.RecordBatch:
        out: dict[str, list[int]] = {}
        for names, (a, b) in self.own.items():
            for f in set(names):
                sums = out.setdefault(f, [0, 0, 0, 0])
                sums[0] += a
                sums[1] += b
        for tag, four in self.edge.items():
            out[f"e:{tag}"] = four
        out["e:*"] = [sum(x) for x in zip(*self.edge.values(), strict=True)] or [0, 0, 0, 0]
        columns = zip(*out.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=[*"kabcd"])


def counted(rows: pa.Table) -> Counts:
    """Rows of :class:`Sums` as counts."""
    out = Counts()
    for k, a, b, c, d in zip(*(rows.column(x).to_pylist() for x in "kabcd"), strict=True):
        if k.startswith("e:"):
            out.edge[k[2:]] = np.array([[a, b], [c, d]]) / UNIT
            continue
        out.own[0][k], out.own[1][k] = a / UNIT, b / UNIT
        if k.startswith("s:"):  # every node has one size
            out.count += (a / UNIT, b / UNIT)
    return out


def block_rows(rows: DataFrame) -> DataFrame:
    """(page, h) for each block of text of ``rows`` (html, page)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(p, h) for t, p in zip(texts(batch.column("html")), batch.column("page").to_pylist(), strict=True) for h in {*block_hashes(parse(t))} - {0}]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["page", "h"])

    return map_arrow(rows, run, "page long, h long").distinct()


def fit(pages: DataFrame, *, bound: int | None = None, least_pages: int = 3, share: float = 0.1, seed: int = 7, most_blocks: int = MOST_BLOCKS, most_keys: int = MOST_KEYS) -> Model:
    """The generated pages' counts, joined by those of all ``pages`` with a html.

    The pages count ``share`` of the generated ones together.  A block of text on
    ``least_pages`` different pages or more is repeated.  Without pages this is
    :func:`default_model`.  With ``bound``, about so many pages at most are looked
    at, by a hash of their id and url.  ``most_blocks`` and ``most_keys`` bound what
    is broadcast, not what counts.
    """
    small_batches(pages.sparkSession)
    rows = pages.where("html is not null")
    if bound is not None and (total := pages.count()) > bound:
        rows = rows.where(F.pmod(F.xxhash64("page_id", "url", F.lit(seed)), F.lit(1 << 30)) < int(bound / total * (1 << 30)))
    rows = rows.select("html", F.xxhash64("html").alias("page"))
    blocks = block_rows(rows)
    often = stored(blocks.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages).select("h"), "blocks")
    if often.count() <= most_blocks:
        repeated = np.sort(often.toArrow().column("h").to_numpy())
    else:
        repeated = None
        marks = blocks.join(often, "h", "left_semi").groupBy("page").agg(F.collect_list("h").alias("marks"))
        rows = rows.join(marks, "page", "left").select("html", "marks")
    base = default_model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            marks = None if repeated is not None else batch.column("marks").to_pylist()
            for i, t in enumerate(texts(batch.column("html"))):
                nodes = parse(t)
                hashes = block_hashes(nodes)
                known = among(hashes, repeated) if marks is None else set(marks[i] or ())
                sums.add(nodes, base.marginals(nodes, signs(nodes, hashes, known)))
            if len(sums) > MOST_SUMS:
                yield sums.rows()
                sums = Sums()
        if len(sums):
            yield sums.rows()

    sums = rows.mapInArrow(count, "k string, a long, b long, c long, d long").groupBy("k").agg(*(F.sum(F.col(x).cast("decimal(20,0)")).cast("double").alias(x) for x in "abcd"))
    sums = stored(sums, "sums")
    whole = sums.count() <= most_keys
    made = generated()
    held = sums if whole else sums.where(F.substring("k", 1, 2).isin("s:", "l:") | F.col("k").isin([*made.own[0], *made.own[1], *(f"e:{k}" for k in made.edge)]))
    found = counted(held.toArrow())
    out = Counts()
    out.merge(made)
    if not found.count.sum():
        return out.model()
    weight = share * made.count.sum() / found.count.sum()
    out.merge(found, weight)
    if whole:
        return out.model()
    scale, total = weight / UNIT, Counts(count=out.count)

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(batch.column(x).to_pylist() for x in "kabcd"), strict=True)
        w = [[*np.ravel(transitions(np.array([[a, b], [c, d]]) * scale))] if k.startswith("e:") else [total.log_ratio(a * scale, b * scale)] for k, a, b, c, d in rows]
        return pa.RecordBatch.from_arrays([batch.column("k"), pa.array(w, pa.list_(pa.float64()))], names=["key", "w"])

    return replace(out.model(), rest=map_arrow(sums.join(held.select("k"), "k", "left_anti"), weigh, "key string, w array<double>"))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages``; a null html is an empty page."""
    model = model or fit(pages)
    held = replace(model, rest=None)
    pages = pages.select("page_id", "url", "html")

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(p, k) for t, p in zip(texts(batch.column("html")), batch.column("page").to_pylist(), strict=True) for k in held.absent(parse(t))]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["page", "key"])

    if model.rest is not None:
        pages = pages.withColumn("page", F.xxhash64("html"))
        found = map_arrow(pages.select("html", "page"), keys, "page long, key string").distinct().join(model.rest, "key")
        pages = pages.join(found.groupBy("page").agg(F.collect_list(F.struct("key", "w")).alias("found")), "page", "left").drop("page")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "found" in batch.schema.names:
            known = ({x["key"]: x["w"] for x in row or ()} for row in batch.column("found").to_pylist())
            found = [held.joined(k).extract(t) for t, k in zip(texts(batch.column("html")), known, strict=True)]
        else:
            found = [held.extract(t) for t in texts(batch.column("html"))]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages, run, "page_id long, url string, text string, n_chars long")
