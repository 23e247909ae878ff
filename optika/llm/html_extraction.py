"""Main-text extraction: gradient-boosted trees over DOM-node features, hierarchically decoded.

Every node (block-level element or run of text) gets the log odds that it holds main text, from boosted regression
trees over its features: tag, tags above, attribute tokens of its own and above, depth, place among its siblings,
text, link and tag density of itself, its subtree and its neighbours.  Decoding keeps the set of nodes of greatest
total log odds in which a kept node's ancestors are kept too, so no article part survives below a dropped menu and
no menu is kept for one odd item.

The trees are trained here, on pages that ``page_samples`` writes: layouts with and without semantic tags, attributes
and tables, with menus, headers, footers, sidebars, notices, adverts, forms, comments and broken markup, of which each
text's role is known.  Their number (``SAMPLE_PAGES``) is fixed.  The trained trees are kept in ``html_trees.json``;
``python -m optika.llm.html_extraction`` writes the file again, and a test holds it against a new training.
"""

from __future__ import annotations

import json
import os
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optika.llm import dom
from optika.llm import textkit as tk

SAMPLE_PAGES, TREES, DEPTH, BINS, RATE, ROWS = 6000, 120, 5, 32, 0.15, 0.4
MODEL_FILE = os.path.join(os.path.dirname(__file__), "html_trees.json")


class Trees:
    """Boosted regression trees on binned features, logistic loss."""

    def __init__(self, cuts: list[np.ndarray], feature: np.ndarray, split: np.ndarray, leaf: np.ndarray, start: float):
        self.cuts, self.feature, self.split, self.leaf, self.start = cuts, feature, split, leaf, start

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, c in enumerate(self.cuts):
            out[:, j] = np.searchsorted(c, x[:, j], "left")
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        rows, score = np.arange(len(b)), np.full(len(b), self.start)
        for feature, split, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            at = np.zeros(len(b), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[rows, feature[at]] > split[at])
            score += leaf[at - (2**DEPTH - 1)]
        return score

    def to_json(self) -> str:
        return json.dumps({"start": self.start, "cuts": [c.tolist() for c in self.cuts], "feature": self.feature.tolist(), "split": self.split.tolist(), "leaf": self.leaf.round(9).tolist()}, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> Trees:
        m = json.loads(text)
        return cls([np.array(c, np.float32) for c in m["cuts"]], np.array(m["feature"]), np.array(m["split"]), np.array(m["leaf"]), m["start"])


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES) -> Trees:
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) if len(np.unique(x[:, j])) > BINS else np.unique(x[:, j])[:-1] for j in range(x.shape[1])]
    inner = 2**DEPTH - 1
    p0 = float(np.average(y, weights=weight))
    model = Trees(cuts, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, inner + 1)), float(np.log(p0 / (1 - p0))))
    b = model.bins(x).astype(np.int64)
    m = x.shape[1]
    flat = b + np.arange(m) * BINS
    score = np.full(len(y), model.start)
    features, splits, leaves = [], [], []
    rng = np.random.Generator(np.random.PCG64(11))
    every_b, every_flat, every_score, every_y, every_weight = b, flat, score, y, weight
    for _ in range(trees):
        # each tree sees a part of the rows
        pick = rng.random(len(every_y)) < ROWS
        b, flat, y, weight = every_b[pick], every_flat[pick], every_y[pick], every_weight[pick]
        p = 1 / (1 + np.exp(-every_score[pick]))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, split = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        for level in range(DEPTH):
            first, k = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (m * BINS) + flat).reshape(-1)
            sums = [np.bincount(cell, np.repeat(v, m), k * m * BINS).reshape(k, m, BINS) for v in (g, h)]
            left_g, left_h = (np.cumsum(s, 2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
            best = gain.reshape(k, -1).argmax(1)
            good = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
            feature[first : first + k] = best // BINS
            split[first : first + k] = np.where(good, best % BINS, BINS)
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > split[at])
        leaf_at = at - inner
        leaf = RATE * np.bincount(leaf_at, g, inner + 1) / (np.bincount(leaf_at, h, inner + 1) + 1)
        at = np.zeros(len(every_y), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (every_b[np.arange(len(every_y)), feature[at]] > split[at])
        every_score += leaf[at - inner]
        features.append(feature)
        splits.append(split)
        leaves.append(leaf)
    return Trees(cuts, np.array(features), np.array(splits), np.array(leaves), model.start)


def decode(odds: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The ancestor-closed set of nodes of greatest total log odds, in which an only child shares its parent's fate."""
    value = odds.copy()
    levels = dom.levels(depth)
    only = np.bincount(parent[parent >= 0], minlength=len(odds))[np.maximum(parent, 0)] == 1
    for at in reversed(levels[1:]):
        np.add.at(value, parent[at], np.where(only[at], value[at], np.maximum(value[at], 0)))
    keep = value > 0
    for at in levels[1:]:
        keep[at] = keep[parent[at]] & (keep[at] | only[at])
    return keep


# -- training pages ---------------------------------------------------------------------------------------------


class _Writer:
    """Writes a random page; texts of the article are marked by a private-use character, removed before reading."""

    MARK = "\ue000"
    #: What sections call themselves, by the role that it tells.
    SAYS = {
        "menu": "Menu|Navigation|Breadcrumb", "advert": "Advertisement|Sponsored|Promoted|Ad", "side": "Related|Popular|More stories|Recommended for you|Trending",
        "comments": "Comments|%d comments|Leave a reply|Discussion|Replies|Reader comments|%d responses", "notice": "Cookies|Notice|Privacy|Warning", "form": "Subscribe|Newsletter|Search|Sign up|Login|Contact",
        "share": "Share|Follow|Tags|Share this",
    }

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        #: A page without attributes, whose sections are told by tags, shape and headings alone.
        self.plain = self.r.random() < 0.2

    def word(self) -> str:
        r = self.r
        w = "".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiouéäó") for _ in range(r.randint(1, 4)))
        return w + r.choice(["", "", "n", "s", "r"])

    def words(self, a: int, b: int, stops: bool = True) -> str:
        r, out = self.r, []
        for i in range(r.randint(a, b)):
            w = self.word()
            out.append(w.capitalize() if i == 0 or (out and out[-1][-1] == ".") else w)
            if stops and r.random() < 0.12:
                out[-1] += r.choice([".", ",", "."])
        return " ".join(out) + (r.choice([".", ".", ""]) if stops else "")

    def says(self, role: str) -> str:
        return self.r.choice(self.SAYS[role].split("|")).replace("%d", str(self.r.randint(2, 99)))

    def link(self, a=1, b=3) -> str:
        return f'<a href="/{self.word()}">{self.words(a, b, False)}</a>'

    def attr(self, *names: str, must: bool = False) -> str:
        r = self.r
        if self.plain or (not must and r.random() < 0.3):
            return ""
        n = r.choice(names)
        n = r.choice([n, n, f"{n}-{self.word()}", f"site-{n}", f"{n} {self.word()}", f"{self.word()}-{n}"])
        return f' {r.choice(["class", "class", "id"])}="{n}"'

    def head(self, role: str, chance: float, tags: str = "h2 h3 h4 b p div") -> str:
        """A heading that names the section; always there where no attribute does."""
        if not self.plain and self.r.random() > chance:
            return ""
        t = self.r.choice(tags.split())
        return f"<{t}>{self.says(role)}</{t}>"

    def menu(self) -> str:
        r = self.r
        items = [self.link() for _ in range(r.randint(2, 12))]
        body = r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items), lambda: "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>", lambda: " ".join(items), lambda: "<br>".join(items), lambda: "".join(f"<p>{x}</p>" for x in items)])()
        return r.choice([f"<nav{self.attr('nav', 'menu')}>{body}</nav>", f"<div{self.attr('menu', 'nav', 'navbar', 'navigation')}>{body}</div>", f"<nav>{body}</nav>"])

    def advert(self) -> str:
        t = self.words(3, 25)
        a, h = self.attr("ad", "ads", "advert", "sponsored", "promo", "banner", "advertisement", must=True), self.head("advert", 0.2, "div p h4 b small")
        return self.r.choice([f"<div{a}>{h}{t}</div>", f"<aside{a}>{h}<p>{t}</p></aside>", f"<div{a}>{h}<p>{t}</p>{self.link()}</div>", f"<section{a}>{h}<h4>{self.words(1, 3, False)}</h4><p>{t}</p></section>"])

    def header(self) -> str:
        inner = self.r.choice(["", f"<h1>{self.words(1, 3, False)}</h1>", f"<div>{self.words(1, 4, False)}</div>", f"<p>{self.words(3, 10)}</p>"])
        return f"<header{self.attr('header', 'masthead', 'top')}>{inner}{self.r.choice(['', self.menu()])}</header>"

    def footer(self) -> str:
        r = self.r
        t = f"{r.choice(['&copy;', '&copy;', '©', 'Copyright', '(c)'])} {self.words(1, 4, False)} {r.choice(['&middot;', '|', '-'])} {self.words(1, 9)}"
        body = r.choice([t, f"<p>{t}</p>", f"<p>{t}</p>" + self.menu(), f"<div>{t}</div><ul><li>{self.link()}</li><li>{self.link()}</li></ul>"])
        return r.choice([f"<footer>{body}</footer>", f"<footer{self.attr('footer')}>{body}</footer>", f"<div{self.attr('footer', 'copyright', 'legal', must=True)}>{body}</div>"])

    def sidebar(self) -> str:
        r = self.r
        inner = self.head("side", 0.4) + "".join(r.choice([f"<h3>{self.words(1, 3, False)}</h3>", f"<p>{self.words(4, 40)}</p>", "<ul>" + "".join(f"<li>{self.link(2, 7)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"]) for _ in range(r.randint(1, 4)))
        return r.choice([f"<aside{self.attr('sidebar', 'side', 'widget', 'related')}>{inner}</aside>", f"<aside>{inner}</aside>", f"<div{self.attr('sidebar', 'widget', 'related', 'recommended', must=True)}>{inner}</div>"])

    def warning(self) -> str:
        """A sentence or two of the kind that asks for consent."""
        w = self.words(7, 30).split(" ")
        for x in self.r.sample(sorted(dom.NOTICE), self.r.randint(2, 4)):
            w[self.r.randrange(len(w))] = x + self.r.choice(["", "", "", ","])
        return " ".join(w) + "."

    def notice(self) -> str:
        if self.r.random() < 0.4:  # nothing but its words tells what it is
            t, b = self.warning(), self.r.choice(["", "", f"<button>{self.word()}</button>", self.link(1, 2)])
            return self.r.choice([f"<div><p>{t}</p>{b}</div>", f"<div>{t}{b}</div>", f"<p>{t}</p>", f"<div><div><p>{t}</p>{b}</div></div>", f"<section><p>{t}</p>{b}</section>"])
        t = self.words(5, 30)
        a, h = self.attr("cookie", "notice", "alert", "consent", "popup", "gdpr", "announcement", "disclaimer", must=True), self.head("notice", 0.2)
        role = "" if self.plain else ' role="alert"'
        return self.r.choice([f"<div{a}>{h}{t}</div>", f"<div{a}>{h}<p>{t}</p><button>{self.word()}</button></div>", f"<div{role}>{h}{t}</div>", f"<section{a}>{h}<p>{t}</p></section>", f"<dialog{a}><p>{t}</p></dialog>"] + ([] if self.plain else [f"<p{a}>{t}</p>"]))

    def form(self) -> str:
        a = self.attr("search", "login", "newsletter", "subscribe", "form", "signup")
        return f"<form{a}>{self.head('form', 0.2)}{self.r.choice(['', f'<p>{self.words(3, 14)}</p>', f'<h3>{self.words(1, 4, False)}</h3>'])}<label>{self.words(1, 3, False)}</label><input name=q><button>{self.word()}</button></form>"

    def comments(self) -> str:
        r = self.r
        name = lambda: r.choice([f"<b>{self.word()}</b>", f"<h4>{self.word()}</h4>", f"<p>{self.word()} {r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(2001, 2030)}</p>", f"<cite>{self.word()}</cite>:", f"<div>{self.word()} says</div>"])
        kinds = [
            lambda: f"<div{self.attr('comment', 'reply')}>{name()}<p>{self.words(3, 50)}</p></div>", lambda: f"<li>{name()}<p>{self.words(3, 50)}</p></li>",
            lambda: f"<article{self.attr('comment', must=True)}>{name()}<p>{self.words(3, 50)}</p></article>", lambda: f"<p>{self.words(3, 40)}</p>", lambda: f"<blockquote>{name()}{self.words(3, 40)}</blockquote>",
            lambda: f"<div{self.attr('comment', 'reply')}>{name()}{self.words(3, 50)}<div>{self.link(1, 1)}</div></div>",
        ]
        one = r.choice(kinds) if r.random() < 0.8 else lambda: r.choice(kinds)()
        a = self.attr("comments", "discussion", "replies", "respond", "disqus", must=True)
        inner = self.head("comments", 0.6) + "".join(one() for _ in range(r.randint(1, 7))) + (self.form() if r.random() < 0.2 else "")
        return r.choice([f"<section{a}>{inner}</section>", f"<div{a}>{inner}</div>", f"<div{a}>{inner}</div>", f"<ol{a}>{inner}</ol>"])

    def share(self) -> str:
        return f"<div{self.attr('share', 'social', 'tags', must=True)}>{self.head('share', 0.2, 'b p h4')}{' '.join(self.link(1, 2) for _ in range(self.r.randint(2, 5)))}</div>"

    def prose(self, a: int, b: int) -> str:
        t = self.words(a, b)
        r = self.r
        if r.random() < 0.15:
            t = t.replace(" ", r.choice([" <b>", " <em>"]), 1) + r.choice(["</b>", "</em>"])
        if r.random() < 0.1:
            t += " " + self.link() + " " + self.words(2, 8)
        if r.random() < 0.04:
            t = t.replace(" ", f" {r.choice(sorted(dom.NOTICE))} ", 1)
        if r.random() < 0.1:
            t = t.replace(" ", r.choice(["&amp; ", "*** ", " &quot;", "### "]))
        return self.MARK + t

    def paragraph(self) -> str:
        r = self.r
        k = r.random()
        if k < 0.09:
            return self.part()
        if k < 0.7:
            return f"<p>{self.prose(*r.choice([(2, 12), (10, 90), (40, 200)]))}" + ("</p>" if r.random() < 0.9 else "")
        if k < 0.8:
            return f"<p><b>{self.prose(2, 40)}<br>"
        if k < 0.86:
            return f"<h{(n := r.randint(2, 4))}>{self.prose(1, 8)}</h{n}>"
        if k < 0.92:
            kind = r.choice(["ul", "ol"])
            return f"<{kind}>" + "".join(f"<li>{self.prose(2, 25)}</li>" for _ in range(r.randint(2, 6))) + f"</{kind}>"
        if k < 0.96:
            return f"<blockquote>{self.prose(5, 50)}</blockquote>"
        if k < 0.97:
            cell = r.choice(["td", "td", "th"])
            return "<table>" + "".join(f"<tr><{cell}>{self.prose(1, 5)}</{cell}><td>{self.prose(1, 5)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if k < 0.98:
            return f"<pre><code>{self.prose(3, 40)}</code></pre>"
        if k < 0.985:
            return "<ul>" + "".join(f"<li>{self.MARK}{self.link(1, 3)} {self.words(3, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        return f"<div>{self.prose(10, 80)}</div>"

    def part(self) -> str:
        """Terms, folded text, captions, wide tables and lists of links that belong to the article."""
        r, end = self.r, self.r.random() < 0.8
        close = lambda t: f"</{t}>" if end else ""
        rows = lambda a, b: "".join("<tr>" + "".join(f"<td>{self.prose(a, b)}{close('td')}" for _ in range(n)) + close("tr") for _ in range(r.randint(2, 5)))
        n = r.randint(2, 4)
        return r.choice([
            lambda: "<dl>" + "".join(f"<dt>{self.prose(1, 6)}{close('dt')}" * r.choice([1, 1, 2]) + f"<dd>{self.prose(3, 40)}{close('dd')}" for _ in range(r.randint(1, 5))) + "</dl>",
            lambda: f"<details{r.choice(['', ' open'])}><summary>{self.prose(1, 8)}</summary>" + r.choice([self.prose(5, 60), "".join(f"<p>{self.prose(5, 60)}</p>" for _ in range(r.randint(1, 3)))]) + "</details>",
            lambda: f"<figure><img src=x>{r.choice(['<figcaption>%s</figcaption>', '<figcaption><p>%s</p></figcaption>']) % self.prose(2, 25)}</figure>",
            lambda: f"<table>{rows(2, 40)}</table>",
            lambda: f"<table><tr>{''.join(f'<th>{self.prose(1, 3)}</th>' for _ in range(n))}</tr>{rows(1, 6)}</table>",
            self.sources,
        ])()

    def sources(self) -> str:
        """A list of links inside the article's text."""
        r = self.r
        kind, long = r.choice(["ul", "ol"]), r.choice([(1, 3), (3, 12)])
        head = r.choice(["", "", f"<h{(n := r.randint(2, 4))}>{self.MARK}{r.choice(['Sources', 'References', 'Notes', 'Further reading', 'Links', self.words(1, 3, False)])}</h{n}>", f"<p>{self.prose(2, 12)}</p>"])
        return head + f"<{kind}>" + "".join(f"<li>{self.MARK}{self.link(*long)}</li>" for _ in range(r.randint(2, 6))) + f"</{kind}>"

    def article(self) -> str:
        r = self.r
        if r.random() < 0.08:
            body = "".join(f"<p>{self.prose(1, 9)}</p>" for _ in range(r.randint(1, 3)))
        else:
            parts = [self.paragraph() for _ in range(r.choice([1, 2, 3, 5, 8, 14]))]
            if len(parts) > 2 and r.random() < 0.3:
                parts.insert(r.randint(1, len(parts) - 1), r.choice([self.advert, self.share, self.sidebar, self.notice, self.form])())
            if len(parts) > 1 and r.random() < 0.15:
                parts.append(self.sources())
            if len(parts) > 2 and r.random() < 0.12:  # chapters
                cut, t = r.randint(1, len(parts) - 1), r.choice(["section", "div"])
                parts = [f"<{t}>{''.join(x)}</{t}>" for x in (parts[:cut], parts[cut:])]
            body = "".join(parts)
        title = r.choice(["", f"<h1>{self.prose(1, 12)}</h1>", f"<h1>{self.prose(1, 12)}</h1>", f"<h2>{self.prose(1, 12)}</h2>"])
        if title and r.random() < 0.2:
            title = f"<header{self.attr('header', 'entry-header', 'title')}>{title}</header>"
        inner = title + body
        if r.random() < 0.15:
            inner = f"<div{self.attr('body', 'text', 'content', 'entry')}>{inner}</div>"
        tail = self.comments() if r.random() < 0.12 else self.share() if r.random() < 0.1 else ""
        a = self.attr("article", "post", "entry", "content", "story", "main")
        bare = self.plain and r.random() < 0.5
        return r.choice([f"<article>{inner}{tail}</article>", f"<article{a}>{inner}{tail}</article>", f"<main{a}>{inner}{tail}</main>", f"<main><article>{inner}{tail}</article></main>", f"<div{a}>{inner}{tail}</div>", f"<section{a}>{inner}{tail}</section>"]) if not bare else f"<div>{inner}</div>{tail}"

    def columns(self, before: list[str], article: str, after: list[str]) -> str:
        """A page laid out in a table: rows for what spans it, cells for the columns."""
        r = self.r
        row = lambda *cells: "<tr>" + "".join(f"<td{r.choice(['', ' valign=top', ' width=20%'])}>{x}" + ("</td>" if r.random() < 0.9 else "") for x in cells) + ("</tr>" if r.random() < 0.9 else "")
        cut, end = r.randint(0, len(before)), r.randint(0, len(after))
        rows = [row(x) for x in before[:cut] if x]
        cells = ["".join(before[cut:]), article, "".join(after[:end])]
        rows.append(row(*(x for x in cells if x)))
        rows += [row(x) for x in after[end:] if x]
        return f"<table{r.choice(['', ' width=100% border=0'])}>" + r.choice(["", "<tbody>"]) + "".join(rows) + "</table>"

    def page(self) -> str:
        r = self.r
        some = lambda f, p: f() if r.random() < p else ""
        before = [some(self.header, 0.4), some(self.menu, 0.6), some(self.advert, 0.4), some(self.notice, 0.3), some(self.form, 0.2), some(self.sidebar, 0.2)]
        after = [some(self.advert, 0.2), some(self.sidebar, 0.3), some(self.comments, 0.35), some(self.form, 0.2), some(self.share, 0.2), some(self.notice, 0.15)]
        if r.random() < 0.15:  # a page with little else than its article
            before, after = ([x if r.random() < 0.2 else "" for x in part] for part in (before, after))
        r.shuffle(before)
        r.shuffle(after)
        article = self.article() if r.random() < 0.97 else ""
        shape = r.random()
        if shape < 0.3:
            body = self.columns(before, article, after)
        elif shape < 0.45:  # nested boxes
            wrap = lambda x: f"<div{self.attr('row', 'col', 'box', 'inner', 'content')}>{x}</div>" if x and r.random() < 0.7 else x
            body = wrap("".join(map(wrap, before))) + wrap(wrap(article) + "".join(map(wrap, after)))
        elif shape < 0.52:  # no box around the article
            inner = article[article.index(">") + 1 : article.rindex("</")] if article else ""
            body = "".join(before) + inner + "".join(after)
        else:
            body = "".join(before) + article + "".join(after)
        if r.random() < 0.3:
            body = f"<div{self.attr('wrapper', 'container', 'page', 'content', 'main')}>{body}</div>"
        body += some(self.footer, 0.8)
        out = f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{body}</body></html>"
        return out[: r.randint(len(out) // 2, len(out))] if r.random() < 0.05 else out


def page_samples(n: int = SAMPLE_PAGES, seed: int = 1) -> tuple[list[dom.Page], np.ndarray]:
    """Written pages and, for each of their nodes, whether it holds main text."""
    pages, labels = [], []
    for i in range(n):
        page = dom.read(_Writer(seed * 1_000_003 + i).page())
        y = np.zeros(len(page.parent), bool)
        for k in range(len(y) - 1, -1, -1):
            t = page.texts[k]
            if t is not None and _Writer.MARK in t:
                y[k] = True
                page.texts[k] = t.replace(_Writer.MARK, "")
                page.chars[k] = len(page.texts[k])
            if y[k] and page.parent[k] >= 0:
                y[page.parent[k]] = True
        pages.append(page)
        labels.append(y)
    return pages, np.concatenate(labels)


_MODEL: list[Trees] = []


def trained(trees: int = TREES) -> Trees:
    """The trees, or the first of them, trained anew."""
    pages, y = page_samples()
    x, _, _ = dom.features(pages)
    is_text = x[:, 0] == 0
    return train(x, y.astype(np.float64), np.where(is_text, 2.0, 1.0) * np.where(y, 3.0, 1.0), trees)


def model() -> Trees:
    """The trees of ``html_trees.json``."""
    if not _MODEL:
        with open(MODEL_FILE) as f:
            _MODEL.append(Trees.from_json(f.read()))
    return _MODEL[0]


def extract(sources: list[str | None], trees: Trees) -> list[list[str]]:
    """The blocks of main text of each page, in page order."""
    pages = [dom.read(s) for s in sources]
    x, parent, depth = dom.features(pages)
    keep = decode(trees.log_odds(x), parent, depth) if len(x) else np.zeros(0, bool)
    out, at = [], 0
    for p in pages:
        n = len(p.parent)
        out.append([t for t, k in zip(p.texts, keep[at : at + n], strict=True) if t is not None and k])
        at += n
    return out


def main_text(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """The main text of every page (page_id, url, html): page_id, url, text, n_chars.

    Blocks are joined by an empty line; a null or empty html, or a page without main text, gives an empty text.  Null
    ids and urls stay null, repeated rows are read each, an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in tk.chunks(batches, "html", 1 << 20):
            texts = ["\n\n".join(b) for b in extract(c.column(2).to_pylist(), shared.value)]
            yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


if __name__ == "__main__":
    with open(MODEL_FILE, "w") as out:
        out.write(trained().to_json())
