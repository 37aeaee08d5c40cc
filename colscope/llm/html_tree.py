"""Main-text extraction from HTML with a tree-structured graphical model over DOM nodes."""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed sets of the HTML standard: elements without content, whose content browsers never show as text of the page, and inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark math object q s samp small span strike strong sub sup svg time tt u var".split())
#: Elements with tags of their own; those tags that are not shown, that part text, and the tags that end the element.
FOREIGN = frozenset("math svg".split())
UNSEEN = frozenset("annotation annotation-xml desc metadata".split())
APART = frozenset("text mtr mtd".split())
OUTER = frozenset("html body article main section div table ul ol dl form aside nav header footer p h1 h2 h3 h4 h5 h6 blockquote pre dd dt li center menu figure hr".split())
#: A start tag of the key ends an open element of the value.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body article main section div table ul ol dl form aside nav header footer".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_MARK = re.compile(r'\bdata-y="([01])"')

#: Words in class, id, role and label attributes, by what they tell.
HINTS = {
    "menu": "nav menu breadcrumb breadcrumbs pagination pager toc tabs skip navigation navbar",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner",
    "side": "sidebar side aside related recommended widget trending popular complementary more",
    "foot": "footer foot copyright legal colophon contentinfo",
    "head": "header masthead topbar top logo brand site-header",
    "comment": "comment comments reply replies respond disqus discussion responses commentlist",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall dialog message warning banner-notice",
    "share": "share sharing social tags meta byline tools toolbar",
    "form": "form login search signup register contact",
    "main": "article content post entry main story text body page document",
}
_HINT = {word: name for name, words in HINTS.items() for word in words.split()}
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    names: str
    mark: int | None = None
    own: int = 0
    linked: int = 0
    words: int = 0
    stops: int = 0
    total: int = 0
    total_linked: int = 0
    children: int = 0
    depth: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    """Block elements as nodes (parents first) and runs of text in page order, each with its block.

    Inline elements only mark their text; comments, scripts, styles and titles leave nothing. Formulas and drawings are
    part of their line. Missing end tags are implied as browsers do for paragraphs, items and cells; an end tag without a
    start is ignored, and so is the start of a raw element other than a script or style that never ends.
    """
    page = Page([Node("#root", -1, "")])
    stack: list[tuple[str, int]] = [("#root", 0)]
    pending: list[str] = []
    links = at = 0
    last = source.rfind(">")  # no tag begins after it

    def flush() -> None:
        nonlocal pending
        if pending:
            if text := " ".join(html.unescape("".join(pending)).split()):
                page.runs.append((stack[-1][1], text))
            pending = []

    def add(text: str) -> None:
        if text:
            pending.append(text)
            node, n = page.nodes[stack[-1][1]], len(text) - text.count(" ")
            node.own += n
            node.linked += n * bool(links)

    def close(k: int) -> None:
        nonlocal links
        if any(tag not in INLINE for tag, _ in stack[k:]):
            flush()
        links -= sum(tag == "a" for tag, _ in stack[k:])
        del stack[k:]

    def foreign() -> bool:
        for tag, _ in reversed(stack):
            if tag in FOREIGN or tag not in INLINE:
                return tag in FOREIGN
        return False

    while at < len(source):
        m = _TOKEN.search(source, at) if at <= last else None
        if m is None:
            add(source[at:].partition("<!--")[0])  # a comment without an end goes on to the end
            break
        add(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag or (tag in INLINE and stack[i][0] not in INLINE) or (tag not in SCOPES and stack[i][0] in SCOPES)), 0)
            if k and stack[k][0] == tag:
                close(k)
            continue
        if tag == "br":
            pending.append(" ")
        if tag in VOID:
            continue
        inside = foreign()
        closed = m[3].endswith("/") and (inside or tag in FOREIGN)  # the slash of other elements means nothing
        if tag in RAW or (inside and tag in UNSEEN):
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(source, at) if not closed else None
            if end:
                at = end.end()
            elif tag in ("script", "style") and not closed:
                at = len(source)
            continue
        if tag in FOREIGN and closed:
            continue
        if inside and tag not in INLINE and tag not in OUTER:
            if tag in APART:
                pending.append(" ")
            continue
        if tag in INLINE:
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
            continue
        flush()
        for i in range(len(stack) - 1, 0, -1):
            open_tag = stack[i][0]
            if open_tag == "p" or open_tag in ENDS.get(tag, ()):
                close(i)
                break
            if open_tag not in INLINE and open_tag in SCOPES:
                break
        while stack[-1][0] in INLINE:
            close(len(stack) - 1)
        parent = stack[-1][1]
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])) if m[3] else ""
        mark = _MARK.search(m[3]) if m[3] else None
        page.nodes.append(Node(tag, parent, names, int(mark[1]) if mark else None, depth=page.nodes[parent].depth + 1))
        page.nodes[parent].children += 1
        stack.append((tag, len(page.nodes) - 1))
    close(1)
    flush()
    for k, text in page.runs:
        page.nodes[k].words += text.count(" ") + 1
        page.nodes[k].stops += text.count(". ") + text.count("? ") + text.count("! ") + text.endswith((".", "?", "!"))
    for i in range(len(page.nodes) - 1, -1, -1):
        node = page.nodes[i]
        node.total += node.own
        node.total_linked += node.linked
        if i:
            page.nodes[node.parent].total += node.total
            page.nodes[node.parent].total_linked += node.total_linked
    return page


def features(node: Node) -> list[str]:
    """Binary features of a node: its element, hints in its names, and the shape of its text."""
    share = node.linked / node.own if node.own else 0.0
    below = node.total_linked / node.total if node.total else 0.0
    hints = {_HINT[w] for w in _WORDS.findall(node.names.lower()) if w in _HINT}
    return [
        "bias",
        f"tag:{node.tag}",
        *[f"hint:{h}" for h in hints],
        *[f"hint:{h}&block" for h in hints if node.children],
        f"words:{min(node.words.bit_length(), 6)}",
        f"stops:{min(node.stops, 2)}&words:{min(node.words.bit_length(), 4)}",
        f"linked:{int(share * 3.99)}",
        f"below:{int(below * 3.99)}",
        f"total:{min(node.total.bit_length() // 2, 6)}",
    ]


@dataclass
class Model:
    """Node weights by feature, and log potentials of (parent label, child label); label 1 is content."""

    weights: dict[str, float] = field(default_factory=dict)
    edges: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])


def _softplus(x: float, y: float) -> float:
    """log(exp(x) + exp(y))"""
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


def marginals(page: Page, model: Model, scores: list[float] | None = None, joint: bool = False) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Sum-product over the tree: one sweep from the leaves up, one from the root down.

    All messages are log odds of label 1. Returns each node's probability of being content and, with ``joint``, which only
    training needs, each node's joint distribution with its parent in the order of ``edges``.
    """
    nodes, (e00, e01, e10, e11) = page.nodes, model.edges
    up = list(scores) if scores is not None else [sum(model.weights.get(f, 0.0) for f in features(n)) for n in nodes]
    message = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        message[i] = _softplus(e10, e11 + up[i]) - _softplus(e00, e01 + up[i])
        up[nodes[i].parent] += message[i]
    belief, pairs = list(up), [(0.25, 0.25, 0.25, 0.25)] * (len(nodes) if joint else 0)
    for i in range(1, len(nodes)):
        rest = belief[nodes[i].parent] - message[i]
        belief[i] = up[i] + _softplus(e01, e11 + rest) - _softplus(e00, e10 + rest)
        if not joint:
            continue
        logs = (e00, e01 + up[i], e10 + rest, e11 + rest + up[i])
        top = max(logs)
        raw = [math.exp(x - top) for x in logs]
        total = sum(raw)
        pairs[i] = (raw[0] / total, raw[1] / total, raw[2] / total, raw[3] / total)
    return [1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, b)))) for b in belief], pairs


def fit(pages: list[Page], rounds: int = 40, rate: float = 0.4, decay: float = 1e-3) -> Model:
    """Maximise the likelihood of the marked labels by adaptive gradient steps: observed less expected statistics."""
    model = Model()
    known = [(p, [features(n) for n in p.nodes], [n.mark if n.mark is not None else 0 for n in p.nodes]) for p in pages]
    squares: dict[str, float] = {}
    edge_squares = [1e-6] * 4
    for _ in range(rounds):
        gradient: dict[str, float] = {}
        edge_gradient = [0.0] * 4
        for page, feats, marks in known:
            scores = [sum(model.weights.get(f, 0.0) for f in fs) for fs in feats]
            probability, pairs = marginals(page, model, scores, joint=True)
            for fs, p, y in zip(feats, probability, marks, strict=True):
                for f in fs:
                    gradient[f] = gradient.get(f, 0.0) + y - p
            for i in range(1, len(marks)):
                seen = 2 * marks[page.nodes[i].parent] + marks[i]
                for k in range(4):
                    edge_gradient[k] += (k == seen) - pairs[i][k]
        for f, g in gradient.items():
            g = g / len(pages) - decay * model.weights.get(f, 0.0)
            squares[f] = squares.get(f, 1e-6) + g * g
            model.weights[f] = model.weights.get(f, 0.0) + rate * g / math.sqrt(squares[f])
        for k in range(4):
            g = edge_gradient[k] / len(pages) - decay * model.edges[k]
            edge_squares[k] += g * g
            model.edges[k] += rate * g / math.sqrt(edge_squares[k])
    return model


class _Author:
    """Writes labelled pages in many layouts; data-y marks what is content or holds it.

    Half of the pages name their parts by words of HINTS; the others give no names, or names that mean nothing, so that
    elements, links and shapes of text are learned for themselves.
    """

    def __init__(self, seed: int, naming: str | None = None):
        self.rnd, self.fixed, self.naming = random.Random(seed), naming, naming

    def words(self, n: int) -> list[str]:
        r = self.rnd
        return ["".join(r.choice(("ta", "re", "on", "li", "mo", "es", "du", "ki", "er", "an")) for _ in range(r.randint(1, 4))) for _ in range(n)]

    def prose(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.rnd.randint(low, high)):
            w = self.words(self.rnd.randint(1, 18))
            out.append(" ".join([w[0].capitalize(), *w[1:]]) + self.rnd.choice("...?!"))
        return " ".join(out)

    def el(self, tag: str, y: int, inner: str, names: str = "") -> str:
        if names and self.naming == "odd":
            names = "".join(self.rnd.choice("qxzkvwjy") for _ in range(5))
        attr = f' {self.rnd.choice(("class", "id"))}="{names}"' if names and self.naming != "none" else ""
        return f'<{tag}{attr} data-y="{y}">{inner}</{tag}>'

    def items(self, y: int, linked: float, low: int = 2, high: int = 7) -> str:
        r = self.rnd
        text = lambda: " ".join(self.words(r.randint(1, 3)))
        li = [self.el("li", y, f'<a href="/{k}">{text()}</a>' if r.random() < linked else (text() if y == 0 else self.prose(1, 1))) for k in range(r.randint(low, high))]
        return self.el(r.choice(("ul", "ul", "ol")), y, "".join(li))

    def boiler(self, kind: str) -> str:
        r = self.rnd
        name = r.choice(HINTS[kind].split()) if r.random() < 0.85 else ""
        inner = {
            "menu": lambda: self.items(0, 1.0),
            "advert": lambda: r.choice((self.prose(1, 2), self.el("p", 0, self.prose(1, 2)), f'<a href="#">{self.prose(1, 1)}</a>')),
            "side": lambda: self.el("h3", 0, " ".join(self.words(2))) + r.choice((self.items(0, 0.9), self.el("p", 0, self.prose(1, 2)))),
            "foot": lambda: r.choice(("", self.items(0, 1.0))) + r.choice(("&copy; 2020 ", "")) + r.choice((self.prose(1, 1), self.el("p", 0, self.prose(1, 2)))),
            "head": lambda: self.el("div", 0, " ".join(self.words(2)), "logo") + r.choice(("", self.boiler("menu"), self.el("h2", 0, " ".join(self.words(3))), self.el("p", 0, self.prose(1, 1)))),
            "comment": lambda: self.el("h3", 0, "3 " + self.words(1)[0]) + "".join(self.el(r.choice(("div", "li", "article")), 0, self.el("p", 0, self.prose(1, 4)), r.choice(("comment", "comment-body", ""))) for _ in range(r.randint(1, 4))),
            "notice": lambda: self.el("p", 0, self.prose(1, 2)) + self.el("button", 0, self.words(1)[0]),
            "share": lambda: self.items(0, 0.8),
            "form": lambda: self.el("label", 0, " ".join(self.words(2))) + "<input>" + r.choice(("", self.el("p", 0, self.prose(1, 1)))) + self.el("button", 0, self.words(1)[0]),
        }[kind]()
        own = {"menu": "nav", "side": "aside", "foot": "footer", "head": "header", "form": "form", "comment": "section"}.get(kind, "div")
        tag = own if not name or r.random() < 0.6 else r.choice(("div", "section"))
        return self.el(tag, 0, inner, name or (kind if tag in ("div", "section") else ""))

    def content(self) -> str:
        r, out = self.rnd, []
        if r.random() < 0.85:
            out.append(self.el(r.choice(("h1", "h1", "h2")), 1, " ".join(self.words(r.randint(1, 9))).capitalize()))
        for _ in range(r.choice((1, 1, r.randint(1, 9), r.randint(1, 9), r.randint(1, 9)))):
            x = r.random()
            if x < 0.62:
                out.append(self.el("p", 1, r.choice(("", "<b>", "<i>x</i>")) + self.prose(1, 5)))
            elif x < 0.70:
                out.append(self.el(r.choice(("h2", "h3")), 1, " ".join(self.words(r.randint(1, 4))).capitalize()))
            elif x < 0.76:
                out.append(self.items(1, 0.15))
            elif x < 0.80:
                out.append(self.el("blockquote", 1, r.choice((self.prose(1, 2), self.el("p", 1, self.prose(1, 2))))))
            elif x < 0.83:
                out.append(self.el("pre", 1, self.prose(1, 3)))
            elif x < 0.86:
                cells = "".join(self.el("tr", 1, self.el("td", 1, self.words(1)[0]) + self.el("td", 1, " ".join(self.words(2)))) for _ in range(3))
                out.append(self.el("table", 1, cells))
            elif x < 0.89:
                out.append(self.el("figure", 1, "<img>" + self.el("figcaption", 1, self.prose(1, 1))))
            elif x < 0.93:
                out.append(self.el(r.choice(("section", "div")), 1, self.el("p", 1, self.prose(1, 4))))
            else:
                out.append(self.boiler(r.choice(("advert", "side", "share", "notice", "form"))))
        return "".join(out)

    def page(self) -> str:
        r = self.rnd
        self.naming = self.fixed or r.choice(("plain", "plain", "none", "odd"))
        tag, name = r.choice((("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post entry"), ("div", "main"), ("section", "story"), ("div", "article-body"), ("div", "")))
        inside = self.content() + (self.boiler("comment") if r.random() < 0.15 else "")
        main = self.el(tag, 1, inside, name)
        for _ in range(r.choice((0, 0, 1, 2))):
            side = [self.boiler(r.choice(("side", "advert", "comment", "share"))) for _ in range(r.randint(0, 2))]
            main = self.el(r.choice(("div", "main", "section", "div")), 1, "".join([*side[:1], main, *side[1:]]), r.choice(("", "wrapper", "container", "row", "page")))
        before = [self.boiler(k) for k in r.sample(("head", "menu", "advert", "notice", "form", "side"), r.randint(0, 4))]
        after = [self.boiler(k) for k in r.sample(("comment", "side", "advert", "foot", "share", "notice", "form"), r.randint(0, 4))]
        return f'<html data-y="1"><head data-y="0"><title>x</title></head><body data-y="1">{"".join(before)}{main}{"".join(after)}</body></html>'


def labelled_pages(n: int, seed: int, naming: str | None = None) -> list[Page]:
    """Training pages written for the purpose, marked node by node; ``naming`` is plain, none, odd, or by default any."""
    author = _Author(seed, naming)
    pages = [parse(author.page()) for _ in range(n)]
    for p in pages:
        p.nodes[0].mark = 1
    return pages


@lru_cache(maxsize=2)
def trained(n: int = 440, seed: int = 5) -> Model:
    return fit(labelled_pages(n, seed), rounds=50)


def main_text(source: str | None, model: Model) -> str:
    """The runs of text whose block is more likely content than not, joined by a space."""
    page = parse(source or "")
    probability, _ = marginals(page, model)
    return " ".join(text for k, text in page.runs if probability[k] > 0.5)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Append text (the page's main text) and n_chars (its code points) to page_id and url.

    Defined cases: null or empty html, and pages without content blocks, give an empty text; broken markup is read as far
    as it goes; repeated rows give repeated results; null ids and urls are kept; other columns are ignored.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or trained())
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, held.value) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
