"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded from the root down."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from hornspark.llm.batches import map_texts
from hornspark.llm.trees import Boosted

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
MATH = frozenset("math semantics annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split())
UNSEEN = frozenset("head script style textarea title xmp iframe noembed noframes noscript template svg select option button input datalist annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img meter progress".split()) | MATH
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: element -> (elements that its start tag closes, elements that this does not reach beyond)
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tbody": (frozenset(["tr", "td", "th", "thead", "tbody", "tfoot"]), frozenset(["table"])),
}
P_SCOPE = frozenset("table td th caption button object applet marquee html body article section div aside nav header footer main li".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_END_RAW: dict[str, re.Pattern] = {}

TAG_GROUPS = [
    ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("div",), ("section",), ("article", "main"), ("nav",), ("header",), ("footer",),
    ("aside",), ("form", "fieldset", "legend"), ("table", "tbody", "thead", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("body", "html"),
]
GROUP = {t: i for i, ts in enumerate(TAG_GROUPS) for t in ts}


class Node:
    """A block-level element; inline markup is part of its block's text."""

    __slots__ = ("tag", "tokens", "parent", "children", "items", "own", "links", "depth", "unseen", "total", "total_links", "nodes", "start")

    def __init__(self, tag: str, tokens: list[str], parent: Node | None, unseen: bool, start: int):
        self.tag, self.tokens, self.parent, self.unseen, self.start = tag, tokens, parent, unseen, start
        self.children: list[Node] = []
        self.items: list = []  # in page order: strings and child nodes
        self.own = self.links = self.total = self.total_links = 0
        self.nodes = 1
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)
            parent.items.append(self)


def attributes(text: str, inline: bool = False) -> tuple[list[str], bool]:
    """Words of class, id, role and the like, and whether the element is hidden.

    ``aria-hidden`` hides inline parts, which repeat a formula or a label; of a block it is a word.
    """
    tokens, hidden = [], False
    for name, a, b, c in _ATTR.findall(text):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "itemtype", "aria-label", "data-role"):
            tokens += _NAME.findall(unescape(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)).lower())
        elif name == "hidden" or inline and name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            hidden = True
        elif name == "aria-hidden" and value == "true":
            tokens.append("aria-hidden")
    return tokens, hidden


def parse(html: str) -> list[Node]:
    """All block nodes in page order, the root first. Broken markup is read as browsers do, roughly."""
    root = Node("html", [], None, False, 0)
    nodes, stack, links, at = [root], [(root, "html")], 0, 0
    #: tag -> places of its open elements in the stack; places of those that aren't inline, and that shelter a p
    where: dict[str, list[int]] = {}
    blocks: list[int] = []
    scopes: list[int] = []

    def push(node: Node, tag: str):
        where.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        if tag in P_SCOPE:
            scopes.append(len(stack))
        stack.append((node, tag))

    def last(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def text(s: str):
        node = stack[-1][0]
        if s and not node.unseen:
            s = unescape(s) if "&" in s else s
            node.items.append(s)
            n = len(s) - s.count(" ") if s.strip() else 0
            node.own += n
            if links:
                node.links += n

    def pop(to: int):
        nonlocal links
        while len(stack) > to:
            tag = stack.pop()[1]
            links -= tag == "a"
            for places in (where[tag], blocks, scopes):
                if places and places[-1] == len(stack):
                    places.pop()

    search = _TOKEN.search
    while m := search(html, at):
        text(html[at : m.start()])
        at = m.end()
        closing, tag, attrs = m[1], m[2], m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag == "br":
                text(" ")
            i = last((tag,))
            if i and (tag not in INLINE or not blocks or i > blocks[-1]):
                pop(i)
            continue
        if tag in CLOSES_P:
            i = last(("p",))
            if i and (not scopes or i > scopes[-1]):
                pop(i)
        if tag in CLOSES:
            shut, scope = CLOSES[tag]
            while (i := last(shut)) > last(scope):
                pop(i)
                if tag in ("li", "dt", "dd", "td", "th", "option"):
                    break
        if tag in VOID:
            if tag == "br" or tag == "img":
                text(" ")
            elif tag == "hr":
                nodes.append(Node("hr", [], stack[-1][0], True, at))
            continue
        if tag in RAW:
            end = _END_RAW.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in ("html", "body") and not attrs.strip("/ "):
            if tag == "html":
                continue
        top = stack[-1][0]
        unseen = top.unseen or tag in UNSEEN
        if tag in INLINE and not unseen:
            # hidden inline parts are nodes of their own, so that they can be left out
            tokens, hidden = attributes(attrs, inline=True) if attrs and ("hidden" in attrs or "none" in attrs) else ([], False)
            if hidden:
                nodes.append(Node(tag, tokens, top, True, at))
                push(nodes[-1], tag)
            else:
                push(top, tag)
            links += tag == "a"
            continue
        tokens, hidden = attributes(attrs) if attrs.strip() else ([], False)
        nodes.append(Node(tag, tokens, top, unseen or hidden, at))
        push(nodes[-1], tag)
        links += tag == "a"
    text(html[at:])
    for n in reversed(nodes):
        n.total += n.own
        n.total_links += n.links
        if n.parent:
            n.parent.total += n.total
            n.parent.total_links += n.total_links
            n.parent.nodes += n.nodes
    return nodes


def node_features(nodes: list[Node], odds: dict[str, float], size: int) -> list[list[float]]:
    """Numbers for each node, see ``matrix``; ``odds``: learned log odds of attribute words."""
    log = math.log1p
    page = max(1, nodes[0].total)
    out: list[list[float]] = []
    #: node -> own log odds, least and most of it and of those above, tag groups down to it, place among siblings
    state: dict = {}
    for n in nodes:
        known = [odds[t] for t in n.tokens if t in odds] if n.tokens else n.tokens
        own = sum(known) if known else 0.0
        up = state[id(n.parent)] if n.parent else (0.0, 0.0, 0.0, 0, None)
        g = GROUP.get(n.tag, -1)
        above = up[3] | (1 << g if g >= 0 else 0)
        beside = None
        if n.children:
            tags: dict[str, int] = {}
            for c in n.children:
                tags[c.tag] = tags.get(c.tag, 0) + 1
            beside = [0, len(n.children), tags, sum([c.total for c in n.children]), sum([c.total_links for c in n.children])]
        state[id(n)] = (own, min(up[1], *known) if known else up[1], max(up[2], *known) if known else up[2], above, beside)
        here, k, tags, sib_text, sib_links = up[4] or (0, 1, {n.tag: 1}, n.total, n.total_links)
        if up[4]:
            up[4][0] += 1
        marks = words = bars = 0
        if n.own:
            text = " ".join([x for x in n.items if isinstance(x, str)])
            marks, words, bars = text.count(".") + text.count(",") + text.count("!") + text.count("?"), len(text.split()), "©" in text or "|" in text
        out.append([
            g, above, len(n.tokens), own, state[id(n)][1], state[id(n)][2], up[0],
            n.depth, log(n.own), log(n.total), n.total / page, n.total_links / (n.total or 1), n.total / n.nodes, log(n.nodes),
            marks / (words or 1), log(words), n.own / (words or 1), n.start / (size or 1), k, here / k, tags[n.tag] / k,
            log(sib_text / k), n.total / (sib_text or 1), sib_links / (sib_text or 1), len(n.children),
            bars, log(n.parent.own if n.parent else 0),
        ])
    return out


def matrix(rows: list[list[float]]) -> np.ndarray:
    """The features with the tag group, and the groups from the root down to the node, as 0 and 1."""
    x = np.array(rows, float)
    groups = np.arange(len(TAG_GROUPS))
    return np.hstack([x[:, 2:], x[:, :1] == groups, x[:, 1:2].astype(np.int64) >> groups & 1])


@dataclass
class Extractor:
    """Trees over node features, and the log odds of attribute words."""

    trees: Boosted
    odds: dict[str, float]

    def __call__(self, pages: list) -> list[str]:
        parsed = [parse(h or "") for h in pages]
        rows = [r for nodes, h in zip(parsed, pages, strict=True) for r in node_features(nodes, self.odds, len(h or ""))]
        logits = self.trees.logits(matrix(rows))
        out, at = [], 0
        for nodes in parsed:
            out.append(decode(nodes, logits[at : at + len(nodes)].tolist()))
            at += len(nodes)
        return out


def chosen(nodes: list[Node], logits: list[float]) -> list[bool]:
    """The best consistent choice: a node is kept only if all nodes above it are.

    Maximises the sum of the log odds of kept nodes, exactly, from the leaves up: below a node
    that is dropped nothing is kept, so a node is kept if it and what is best below it gain.
    """
    index = {id(n): i for i, n in enumerate(nodes)}
    gain = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        gain[i] += logits[i]
        if n.unseen or (not n.total and i):
            gain[i] = 0.0
        if n.parent and gain[i] > 0:
            gain[index[id(n.parent)]] += gain[i]
    keep = [True] * len(nodes)
    for i, n in enumerate(nodes):
        if n.parent:
            keep[i] = keep[index[id(n.parent)]] and gain[i] > 0
    return keep


def decode(nodes: list[Node], logits: list[float]) -> str:
    """Texts of the kept blocks in page order; the root and body are kept as containers only."""
    keep = {id(n) for n, k in zip(nodes, chosen(nodes, logits), strict=True) if k}
    of = dict(zip(map(id, nodes), logits, strict=True))
    blocks: list[str] = []
    part: list[str] = []

    def close():
        if part:
            s = _SPACE.sub(" ", "".join(part)).strip()
            if s:
                blocks.append(s)
            part.clear()

    # an explicit stack: pages can be nested deeper than Python's recursion allows
    stack: list = [(nodes[0], iter(nodes[0].items))]
    while stack:
        node, items = stack[-1]
        for x in items:
            if isinstance(x, str):
                if of[id(node)] > 0 or node.parent and node.tag != "body":
                    part.append(x)
            elif id(x) in keep:
                close()
                stack.append((x, iter(x.items)))
                break
            elif x.tag not in INLINE:
                close()
        else:
            close()
            stack.pop()
    return "\n".join(blocks)


def extract(df: DataFrame, model: Extractor, html_col: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` (the main text) and ``n_chars`` (its code points) of every page.

    A null or empty page, or one without main text, gives an empty text. Repeated rows stay; an
    empty table gives an empty one; other columns are dropped. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # some dozens of small trees

    def make():
        model = shared.value

        def f(pages):
            out = model(pages)
            return {"text": out, "n_chars": [len(t) for t in out]}

        return f

    return map_texts(df, make, {"text": "string", "n_chars": "bigint"}, html_col, list(keep))
