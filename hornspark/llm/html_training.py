"""Training of the main-text extractor on pages that are made up here, with known main text."""

from __future__ import annotations

import math
import random
from collections import Counter
from functools import lru_cache

import numpy as np

from hornspark.llm.html import Extractor, Node, matrix, node_features, parse
from hornspark.llm.trees import boost

#: Pages that are made up, and passes of the seed; the whole training sample.
PAGES = 420

#: Stands before each word of main text while the labels are taken; no feature sees it.
MARK = "\ue000"

SYLLABLES = "an be co da el fi gro hu is jo ka lu me no or pa qui ra se ti un va wo xe yo zu th er in on at en ed é ü ñ ción keit eau".split()
MAIN_NAMES = ["content", "post", "post-content", "entry-content", "article-body", "articleBody", "story", "story-body", "main-content", "main", "text", "body-text", "page-content", "entry", "article", "post-body", "single-post", "prose", "markdown-body", "node-content"]
BOX_NAMES = ["container", "wrapper", "row", "col", "inner", "page", "site", "layout", "grid", "section", "block", "w-full", "app", "root", "flex"]
JUNK = {
    "nav": ["nav", "menu", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "pagination", "pager", "toc", "tabs", "links", "skip"],
    "header": ["header", "site-header", "masthead", "topbar", "banner", "logo", "page-header", "branding", "head"],
    "footer": ["footer", "site-footer", "copyright", "legal", "colophon", "bottom", "foot", "credits"],
    "aside": ["sidebar", "aside", "widget", "related", "related-posts", "recommended", "trending", "rail", "popular", "more-stories", "read-more", "tags", "categories", "author-box", "side"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "adsense", "banner-ad", "adbox", "sponsor", "partner"],
    "notice": ["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "banner", "message", "warning", "overlay", "paywall", "announcement", "disclaimer", "privacy"],
    "form": ["newsletter", "subscribe", "signup", "search", "login", "contact-form", "form", "search-form", "feedback", "poll"],
    "comments": ["comments", "comment-list", "comments-area", "disqus", "discussion", "responses", "replies", "respond", "reader-comments", "comment", "reviews"],
    "share": ["share", "social", "share-buttons", "follow", "sharing", "social-links"],
}


class Maker:
    """Pages with varied templates, tag choices and broken markup."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(SYLLABLES) for _ in range(r.choice([1, 1, 2, 2, 3])))

    def text(self, n: int, main: bool, marks: bool = True) -> str:
        r = self.r
        noise = r.choice(["", "", "", "", "!!", "###", "&amp;&amp;", " |"])
        words = [(MARK if main else "") + self.word() + noise + (r.choice([".", ",", "."]) if marks and r.random() < 0.15 else "") for _ in range(max(1, n))]
        if marks:
            words[0] = words[0].title() if not main else MARK + words[0][1:].title()
            words[-1] = words[-1].rstrip(".,") + "."
        if r.random() < 0.15:
            words.insert(r.randrange(len(words) + 1), ("" if not main else MARK) + r.choice(["&copy;", "&amp;", "&middot;", "2024", "a@b.example", "+1 (555) 555-0100"]))
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            i = r.randrange(len(words))
            t = r.choice(["b", "em", "strong", "a", "i", "span", "code"])
            words[i] = f'<{t}{" href=/x" if t == "a" else ""}>{words[i]}</{t}>'
        return " ".join(words)

    def names(self, of: list[str]) -> str:
        r = self.r
        some = [r.choice(of)] + [r.choice(BOX_NAMES)] * (r.random() < 0.2)
        return f' {r.choice(["class", "class", "id"])}="{" ".join(some)}"'

    def links(self, n: int) -> str:
        r = self.r
        items = [f"<li><a href='/{self.word()}'>{self.text(r.choice([1, 1, 2, 6]), False, False)}</a></li>" for _ in range(n)]
        if r.random() < 0.2:
            return " ".join(x[4:-5] for x in items)
        return f"<ul>{''.join(items)}</ul>"

    def paragraphs(self, n: int, main: bool) -> str:
        r = self.r
        out = []
        broken = r.random() < 0.3
        for _ in range(n):
            t = self.text(r.choice([1, 3, 8, 15, 30, 60, 120]), main)
            if r.random() < 0.15:
                t = f"<b>{t}" + ("<br>" if broken else "</b>")
            out.append(f"<p>{t}" + ("" if broken and r.random() < 0.6 else "</p>"))
        return r.choice(["", "\n"]).join(out)

    def junk(self, kind: str | None = None) -> str:
        r = self.r
        kind = kind or r.choice(list(JUNK))
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        if semantic and r.random() < 0.65:
            tag, attr = semantic, self.names(JUNK[kind]) if r.random() < 0.4 else ""
        else:
            tag, attr = r.choice(["div", "div", "section"] if kind != "ad" else ["div", "div", "aside", "ins"]), self.names(JUNK[kind])
        if kind == "nav":
            inner = self.links(r.randint(1, 12))
        elif kind == "header":
            inner = r.choice([f"<h1>{self.text(2, False, False)}</h1>", f"<a href=/>{self.text(2, False, False)}</a>", f"<p>{self.text(6, False)}</p>"]) + (self.junk("nav") if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = r.choice(["", "<p>", "<div>"]) + r.choice(["&copy; ", "", "Copyright "]) + self.text(r.choice([2, 8, 25]), False) + (self.links(r.randint(2, 9)) if r.random() < 0.4 else "")
        elif kind == "aside":
            inner = f"<h3>{self.text(2, False, False)}</h3>" + r.choice([self.links(r.randint(2, 8)), self.paragraphs(r.randint(1, 3), False)])
        elif kind == "form":
            inner = f"<label>{self.text(2, False, False)}</label><input name=q><button>{self.word()}</button>" + (f"<p>{self.text(10, False)}</p>" if r.random() < 0.6 else "")
            inner = inner if tag == "form" or r.random() < 0.3 else f"<form>{inner}</form>"
        elif kind == "comments":
            t = r.choice(["li", "div", "article"])
            one = "".join(f'<{t}{self.names(["comment", "reply", "comment-body"])}><p>{self.text(2, False, False)}</p><p>{self.text(r.choice([5, 20, 50]), False)}</p></{t}>' for _ in range(r.randint(1, 6)))
            inner = f"<h2>{self.text(2, False, False)}</h2>" + (f"<ol>{one}</ol>" if t == "li" else one)
        elif kind == "share":
            inner = self.links(r.randint(2, 5))
        else:
            inner = r.choice([self.text(r.choice([3, 9, 20, 40]), False), f"<p>{self.text(r.choice([5, 20]), False)}</p>", f"<p>{self.text(9, False)}</p><a href=/x>{self.word()}</a>"])
        return f"<{tag}{attr}>{inner}</{tag}>"

    def story(self) -> str:
        r = self.r
        out = [f"<h1>{self.text(r.randint(2, 12), True, False)}</h1>"] if r.random() < 0.85 else []
        if out and r.random() < 0.15:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(r.choice([0, 1, 2, 4, 8])):
            out.append(self.paragraphs(r.randint(1, 6), True))
            k = r.random()
            if k < 0.12:
                out.append(f"<h2>{self.text(3, True, False)}</h2>")
            elif k < 0.22:
                out.append("<ul>" + "".join(f"<li>{self.text(r.choice([2, 8, 20]), True)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.28:
                out.append(f"<blockquote>{self.paragraphs(1, True)}</blockquote>")
            elif k < 0.33:
                out.append(f"<pre>{self.text(12, True, False)}</pre>")
            elif k < 0.38:
                out.append("<table>" + "".join(f"<tr><td>{self.text(2, True, False)}</td><td>{self.text(3, True, False)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.42:
                out.append(f"<figure><img src=x><figcaption>{self.text(8, True)}</figcaption></figure>")
            elif k < 0.55:
                out.append(self.junk(r.choice(["ad", "aside", "form", "share", "notice"])))
        if len(out) < 2:
            out.append(self.paragraphs(r.randint(1, 3), True) if r.random() < 0.8 else self.text(r.choice([10, 60]), True))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        if r.random() < 0.03:  # no template at all
            body = r.choice([self.paragraphs(r.randint(1, 4), True), self.text(40, True), f"<h1>{self.text(4, True)}</h1>{self.paragraphs(2, True)}"])
            return f"<html><head><title>x</title></head><body>{body}</body></html>"
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        named = tag in ("div", "section") or r.random() < 0.3
        body = f"<{tag}{self.names(MAIN_NAMES) if named else ''}>{self.story()}" + (self.junk("comments") if r.random() < 0.2 else "") + f"</{tag}>"
        if r.random() < 0.3:
            body = f"<{r.choice(['main', 'div', 'div'])}{self.names(MAIN_NAMES) if r.random() < 0.5 else ''}>{body}{self.junk() if r.random() < 0.4 else ''}</div>"
        before = [self.junk(k) for k in r.sample(["header", "nav", "notice", "ad", "form", "nav", "aside"], r.randint(0, 4))]
        after = [self.junk(k) for k in r.sample(["comments", "aside", "footer", "ad", "share", "form", "footer", "notice", "nav"], r.randint(0, 5))]
        body = "".join(before) + body + "".join(after)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<div{self.names(BOX_NAMES) if r.random() < 0.7 else ''}>{body}</div>"
        body = f"<!-- {self.word()} -->" * r.randint(0, 1) + body + ("<script>var a='<p>x</p>';</script>" if r.random() < 0.4 else "")
        end = "</body></html>" if r.random() < 0.85 else ""
        return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.word()}</title><style>p{{margin:0}}</style></head><body>{body}{end}'


def labels(nodes: list[Node]) -> list[bool]:
    """Whether each node has main text in or below it."""
    out = {id(n): any(MARK in x for x in n.items if isinstance(x, str)) for n in nodes}
    for n in reversed(nodes):
        if n.parent:
            out[id(n.parent)] |= out[id(n)]
    return [out[id(n)] for n in nodes]


def truth(html: str) -> str:
    """The main text of a made-up page."""
    from hornspark.llm.html import decode

    nodes = parse(html)
    return decode(nodes, [1.0 if y else -1e9 for y in labels(nodes)]).replace(MARK, "")


@lru_cache(maxsize=4)
def train(pages: int = PAGES, seed: int = 11) -> Extractor:
    """Fit on ``pages`` made-up pages; takes some seconds on the driver."""
    maker = Maker(seed)
    made = [maker.page() for _ in range(pages)]
    good, all_ = Counter(), Counter()
    parsed = []
    for h in made:
        y = labels(parse(h))
        nodes = parse(h.replace(MARK, ""))
        parsed.append((nodes, y, len(h)))
        for n, main in zip(nodes, y, strict=True):
            for t in set(n.tokens):
                all_[t] += 1
                good[t] += main
    odds = {t: math.log((good[t] + 0.5) / (n - good[t] + 0.5)) for t, n in all_.items() if n >= 2}
    x, y = [], []
    for nodes, main, size in parsed:
        for n, row, label in zip(nodes, node_features(nodes, odds, size), main, strict=True):
            if n.total and not n.unseen:
                x.append(row)
                y.append(label)
    return Extractor(boost(matrix(x), np.array(y, float)), odds)
