"""Main text of web pages by a tree-structured graphical model.

Every block element and text run is a binary variable, content or not; a
container is content if any text in it is. Unary potentials read tags, names
and text, a potential on each parent-child pair ties neighbours. Sum-product
messages go up and then down the tree, so each run's marginal is exact.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.html_tree import SILENT, Node, parse

#: Labelled pages a model is trained on, and passes over them.
TRAIN_PAGES = 240
EPOCHS = 25

# --- fixed values: words in class, id and role that speak for or against content --
NAME_WORDS = {
    "content": "article content post entry body main text story prose chapter",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc skip tabs",
    "head": "header masthead banner topbar branding logo",
    "foot": "footer copyright contentinfo legal colophon imprint",
    "side": "sidebar aside complementary rail widget related recommended recommendations trending popular teaser more tags",
    "ad": "ad ads advert advertisement adslot sponsor sponsored promo promotion outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog paywall banner newsletter subscribe signup",
    "form": "form search login register contact",
    "social": "share sharing social follow",
    "comment": "comment comments commentlist reply replies respond discussion disqus reader",
}
NAME_KIND = {w: kind for kind, words in NAME_WORDS.items() for w in words.split()}
NAME = re.compile(r"[a-z]+")
BOILER_TEXT = re.compile(r"(?i)©|\(c\) ?\d{4}|all rights reserved|cookie|subscribe|sign up|log ?in|privacy policy|terms of")


def features(nodes: Sequence[Node]) -> list[list[str]]:
    """The names of each node's binary features."""
    n = len(nodes)
    size, linked, runs = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if nodes[i].tag == "#text":
            size[i], linked[i], runs[i] = len(nodes[i].text), nodes[i].linked, 1
        if nodes[i].parent >= 0:
            p = nodes[i].parent
            size[p] += size[i]
            linked[p] += linked[i]
            runs[p] += runs[i]
    out = []
    for i, node in enumerate(nodes):
        share = linked[i] / size[i] if size[i] else 0.0
        link = 0 if share == 0 else 1 if share < 0.34 else 2 if share < 0.75 else 3
        if node.tag == "#text":
            parent = nodes[node.parent].tag if node.parent >= 0 else "#page"
            length = sum(size[i] >= x for x in (15, 50, 120, 300))
            names = ["run", f"in:{parent}", f"length:{length}", f"links:{link}"]
            names.append("stop" if node.text[-1] in ".!?…\"”»:" else "open")
            if length < 4 and BOILER_TEXT.search(node.text):
                names.append("phrase")
        else:
            mean = size[i] / runs[i] if runs[i] else 0
            names = ["element", f"tag:{node.tag}", f"mean:{sum(mean >= x for x in (15, 50, 120, 300))}", f"inner:{link}"]
            if node.names:
                names += {f"name:{NAME_KIND[w]}" for w in NAME.findall(node.names) if w in NAME_KIND}
            if node.hidden:
                names.append("hidden")
        out.append(names)
    return out


def _soft(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


@dataclass
class PageModel:
    """Weights of unary features, and log potentials pair[parent][child]."""

    weights: dict[str, float] = field(default_factory=dict)
    pair: list[list[float]] = field(default_factory=lambda: [[1.0, -3.0], [0.0, 1.0]])

    def unary(self, nodes: Sequence[Node], names: Sequence[Sequence[str]]) -> list[float]:
        get = self.weights.get
        return [-60.0 if node.tag in SILENT else sum(get(f, 0.0) for f in fs) for node, fs in zip(nodes, names)]

    def marginals(self, nodes: Sequence[Node], unary: Sequence[float]) -> tuple[list[float], list[float], list[float]]:
        """(log odds of content, upward message, log odds without what comes up from the node itself) of each node.

        Messages are log odds: upward from leaves to the root, then downward,
        each once, so the marginals are those of the whole tree.
        """
        (p00, p01), (p10, p11) = self.pair
        below, up, rest = list(unary), [0.0] * len(nodes), [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            up[i] = _soft(p10, p11 + below[i]) - _soft(p00, p01 + below[i])
            below[nodes[i].parent] += up[i]
        odds = list(below)
        for i in range(1, len(nodes)):
            rest[i] = odds[nodes[i].parent] - up[i]
            odds[i] = below[i] + _soft(p01, p11 + rest[i]) - _soft(p00, p10 + rest[i])
        return odds, below, rest

    def blocks(self, html: str | None) -> list[tuple[str, float]]:
        """(text, probability of content) of every text run in page order."""
        nodes = parse(html)
        odds, _, _ = self.marginals(nodes, self.unary(nodes, features(nodes)))
        return [(n.text, _sigmoid(z)) for n, z in zip(nodes, odds) if n.tag == "#text"]

    def text(self, html: str | None) -> str:
        """The runs more likely content than not, joined by blank lines; empty for null and empty pages."""
        return "\n\n".join(t for t, p in self.blocks(html) if p > 0.5)


def train(pages: Sequence[str], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-3, seed: int = 11) -> PageModel:
    """Maximum likelihood on labelled pages, by steps along observed minus expected features.

    In a labelled page an attribute ``data-y`` marks an element 1 or 0 and
    holds for the text in it up to the next mark; unmarked text is 0. A
    container is 1 if a text run in it is.
    """
    model, sums = PageModel(), {}
    pair_sums = [[1e-8, 1e-8], [1e-8, 1e-8]]
    prepared = []
    for html in pages:
        nodes = parse(html)
        marks, y = [""] * len(nodes), [0] * len(nodes)
        for i, n in enumerate(nodes):
            marks[i] = n.label or (marks[n.parent] if n.parent >= 0 else "")
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[i].tag == "#text":
                y[i] = int(marks[i] == "1")
            y[nodes[i].parent] |= y[i]
        prepared.append((nodes, features(nodes), y))
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(prepared)
        for nodes, names, y in prepared:
            odds, below, rest = model.marginals(nodes, model.unary(nodes, names))
            slope: dict[str, float] = {}
            pairs = [[0.0, 0.0], [0.0, 0.0]]
            for i, fs in enumerate(names):
                if nodes[i].tag in SILENT:
                    continue
                d = y[i] - _sigmoid(odds[i])
                if abs(d) > 1e-4:
                    for f in fs:
                        slope[f] = slope.get(f, 0.0) + d
                if i:
                    joint = [[math.exp(min(60.0, model.pair[a][b] + a * rest[i] + b * below[i])) for b in (0, 1)] for a in (0, 1)]
                    whole = sum(map(sum, joint))
                    for a in (0, 1):
                        for b in (0, 1):
                            pairs[a][b] += (y[nodes[i].parent] == a and y[i] == b) - joint[a][b] / whole
            for f, g in slope.items():
                g -= decay * model.weights.get(f, 0.0)
                sums[f] = sums.get(f, 1e-8) + g * g
                model.weights[f] = model.weights.get(f, 0.0) + rate * g / math.sqrt(sums[f])
            for a in (0, 1):
                for b in (0, 1):
                    g = pairs[a][b] - decay * model.pair[a][b]
                    pair_sums[a][b] += g * g
                    model.pair[a][b] += rate * g / math.sqrt(pair_sums[a][b])
    return model


def labelled_pages(count: int = TRAIN_PAGES, seed: int = 5) -> list[str]:
    """Labelled pages of many layouts, made by rule: articles among menus, notices, adverts, forms and comments."""
    rng = random.Random(seed)
    syllables = "ba ter ion lo mi sen ka du ra ve tin os pel gra ha no ri schu é ñ ö ция 日 本".split()
    tails = [""]  # some pages end their words in signs
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice(tails)
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(1, 18).capitalize() + rng.choice("...!?")
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    links = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(a, b))) + "</ul>"

    def named(kinds: str, tags: str = "div section aside") -> tuple[str, str]:
        tag = rng.choice(tags.split())
        name = rng.choice(NAME_WORDS[rng.choice(kinds.split())].split())
        return tag, f' {rng.choice(["class", "id"])}="{rng.choice(["", "site-", "js-", "page_"])}{name}"'

    def boiler(kind: str) -> str:
        if kind == "menu":
            tag, attr = rng.choice([("nav", ""), ("ul", ' class="menu"'), named("menu")])
            return f"<{tag}{attr}>{links(3, 9)}</{tag}>"
        if kind == "header":
            tag, attr = rng.choice([("header", ""), named("head")])
            inside = rng.choice(["h1", "p", "div"])
            return f"<{tag}{attr}><{inside}>{words(1, 5)}</{inside}>{link()}</{tag}>"
        if kind == "footer":
            tag, attr = rng.choice([("footer", ""), named("foot")])
            return f"<{tag}{attr}>&copy; {word()} &middot; {prose(1, 2)} {rng.choice([link(), ''])}</{tag}>"
        if kind == "side":
            tag, attr = rng.choice([("aside", ""), named("side")])
            return f"<{tag}{attr}><h3>{words(1, 3)}</h3>{rng.choice([links(2, 6), f'<p>{prose(1, 3)}</p>'])}</{tag}>"
        if kind == "form":
            tag, attr = rng.choice([("form", ""), named("form notice", "form div")])
            return f"<{tag}{attr}><label>{words(1, 3)}</label><input name=q><button>{word()}</button><p>{prose(1, 1)}</p></{tag}>"
        if kind == "comment":
            tag, attr = named("comment", "section div ol")
            one = lambda: f'<{"li" if tag == "ol" else "div"} class="{rng.choice(["comment", "reply", "c"])}"><b>{word()}</b><p>{prose(1, 4)}</p></{"li" if tag == "ol" else "div"}>'
            return f"<{tag}{attr}><h3>{words(1, 2)}</h3>{''.join(one() for _ in range(rng.randint(1, 5)))}</{tag}>"
        tag, attr = named("notice" if kind == "notice" else "ad" if kind == "ad" else "social", "div section p")
        return f"<{tag}{attr}>{rng.choice([prose(1, 3), link(), prose(1, 1) + link()])}</{tag}>"

    def body(inner: bool) -> str:
        level = rng.choice("1112")
        parts = [f"<h{level}>{words(2, 10)}</h{level}>"] if rng.random() < 0.85 else []
        if rng.random() < 0.2:
            parts = [f"<header>{p}</header>" for p in parts]
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.7:
                parts.append(f"<p>{rng.choice(['', '<b>', '<em>'])}{prose(1, rng.choice([1, 2, 8]))}" + rng.choice(["</p>", "<br>", f" {link()} {prose(1, 2)}</p>"]))
            elif r < 0.76:
                parts.append(f"<h2>{words(1, 6)}</h2>")
            elif r < 0.82:
                parts.append("<ul>" + "".join(f"<li>{prose(1, 1)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.86:
                parts.append(f"<blockquote><p>{prose(1, 3)}</p></blockquote>")
            elif r < 0.89:
                parts.append(f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>")
            elif r < 0.92:
                parts.append(f"<figure><img src=x><figcaption>{prose(1, 1)}</figcaption></figure>")
            elif r < 0.95:
                parts.append(f"<pre>{words(3, 20)}</pre>")
            elif inner:
                parts.append(f'<div data-y="0">{boiler(rng.choice(["ad", "share", "side", "form", "notice", "menu"]))}</div>')
        if inner and rng.random() < 0.25:
            parts.append(f'<div data-y="0">{boiler("comment")}</div>')
        return "".join(parts)

    made = []
    for _ in range(count):
        tails[:] = rng.choice([[""], [""], [""], ["***", "###", "$$"], ["!!"], [" |"]])
        tag, attr = rng.choice([("article", ""), ("article", ""), ("main", ""), named("content", "div section"), named("content", "div section"), ("div", "")])
        article = f'<{tag}{attr} data-y="1">{body(rng.random() < 0.5)}</{tag}>'
        if rng.random() < 0.3:
            article = f"<div{rng.choice(['', ' class=wrap', ' id=container'])}>{article}{boiler('side') if rng.random() < 0.5 else ''}</div>"
        kinds = ["menu", "header", "notice", "ad", "side", "form", "share"]
        before = [boiler(rng.choice(kinds)) for _ in range(rng.randint(0, 4))]
        after = [boiler(rng.choice(["comment", "side", "ad", "menu", "form", "notice", "footer"])) for _ in range(rng.randint(0, 4))]
        foot = [boiler("footer")] if rng.random() < 0.8 else []
        head = f"<head><title>{words(1, 5)}</title><style>p{{margin:0}}</style></head>"
        page = f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{article}{''.join(after)}{''.join(foot)}</body></html>"
        # Some pages break off.
        made.append(page if rng.random() < 0.85 else page[: rng.randint(len(page) // 3, len(page))])
    return made


def extract(pages: DataFrame, model: PageModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row: the main text of its whole page.

    Null and empty pages, and pages without content, have an empty text and 0
    characters. Repeated rows stay, other columns are ignored, an empty table
    gives an empty result. A task holds one page's tree at a time.
    """

    @F.pandas_udf("string")
    def main_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in parts:
            yield pd.Series([model.text(h) for h in htmls], dtype="object")

    rows = pages.select(F.col(id_col), F.col(url_col), main_text(F.col(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
