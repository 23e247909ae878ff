"""A forgiving HTML reader: block-level nodes of a page and their features.

Nodes come in page order, parents before children, so that the nodes below one follow it without a gap.  Block-level
elements are nodes, as are table cells; a maximal run of text and inline elements is a text node below the element that
holds it.  A table row is one text, its cells separated by blanks, if each cell that holds anything holds one line of inline
text that is no menu (several links that are most of it), whatever its length; other cells' texts stand by themselves.

Reading and features take time in proportion to the page, however deep it is or wrong its tags are.
"""

from __future__ import annotations

import html
import re

import numpy as np

BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header footer nav aside form fieldset "
    "address details summary hr center dialog menu search hgroup legend noscript iframe".split()
)
SILENT = frozenset("script style template svg head title noscript iframe object canvas audio video select textarea datalist".split())
#: Silent elements whose content is text: without an end tag they reach to the end of the page.
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag ends these open elements first (up to a containing block of the second set).
CLOSES = {
    **dict.fromkeys(BLOCK - {"html", "body"}, frozenset(["p"])),
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]),
    **dict.fromkeys(("td", "th"), frozenset(["td", "th", "p"])), **dict.fromkeys(("thead", "tbody", "tfoot"), frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "p"])),
}
FENCE = frozenset("ul ol dl table body article section main div aside nav form header footer blockquote td th".split())
_CELLS = frozenset("tr td th thead tbody tfoot caption table".split())
TAGS = "text p div li ul ol h1 h2 h3 h4 h5 h6 article main section nav aside header footer form table tr td blockquote pre figure figcaption dl dt dd body html".split()
_TAG_ID = {t: i for i, t in enumerate(TAGS)}
#: Elements that a node is told to lie in, however far above.
WITHIN = "article main section aside nav header footer form details dl table figure".split()
_WITHIN = {t: 1 << i for i, t in enumerate(WITHIN)}
#: Groups of attribute tokens.
TOKENS = (
    "content article post entry story main body text blog prose read page-body",
    "nav menu breadcrumb breadcrumbs toc topbar navbar tabs pagination pager navigation",
    "header masthead banner-top site-header top logo",
    "footer foot copyright colophon legal site-footer bottom credits",
    "sidebar side aside widget related recommended recommendations popular trending rail more",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted banner adbox",
    "comment comments reply replies respond discussion disqus thread feedback reader responses",
    "cookie cookies consent notice alert gdpr warning message popup modal overlay announcement notification privacy disclaimer",
    "form search login signup subscribe newsletter register contact input email",
    "share social follow tags meta byline author date toolbar buttons",
)
_GROUP = {w: i for i, g in enumerate(TOKENS) for w in g.split()}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(?:id|class|role|aria-label|itemprop|data-component)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_MARKS = {t: re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*>|<(/?)({t})(?=[\s/>])[^>]*>", re.I | re.S) for t in SILENT - RAW - {"head"}}


#: Texts of at most this many characters are searched for the words of TOKENS: headings and labels, not prose.
SHORT = 40
#: Words by which a notice without attributes shows itself, looked for in texts of at most so many characters.
NOTICE = frozenset("cookie cookies consent gdpr privacy accept agree preferences javascript adblocker browser settings policy".split())
NOTICE_CHARS = 400


class Page:
    """Columns of a page's nodes."""

    __slots__ = ("parent", "depth", "end", "tag", "groups", "above", "says", "chars", "link_chars", "words", "stops", "texts", "inline", "warns", "links", "breaks", "within")

    def __init__(self):
        for c in self.__slots__:
            setattr(self, c, [])

    def add(self, parent: int, tag: str, groups: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.end.append(0)
        self.tag.append(_TAG_ID.get("td" if tag == "th" else tag, _TAG_ID["div"]))
        self.groups.append(groups)
        self.above.append(self.above[parent] | self.groups[parent] if parent >= 0 else 0)
        self.within.append((self.within[parent] if parent >= 0 else 0) | _WITHIN.get(tag, 0))
        for c in (self.says, self.chars, self.link_chars, self.words, self.stops, self.inline, self.warns, self.links, self.breaks):
            c.append(0)
        self.texts.append(None)
        return len(self.parent) - 1

    def write(self, i: int, text: str, linked: int, tags: int, links: int, breaks: int) -> None:
        self.texts[i] = text
        self.chars[i] = len(text)
        self.link_chars[i] = min(linked, len(text))
        self.words[i] = text.count(" ") + 1
        self.stops[i] = text.count(".") + text.count("!") + text.count("?") + text.count(",") + text.count("。")
        self.inline[i], self.links[i], self.breaks[i] = tags, links, breaks
        words = _SPLIT.split(text.lower()) if len(text) <= NOTICE_CHARS else ()
        self.warns[i] = len(NOTICE.intersection(words))
        self.says[i] = _named(words) if len(text) <= SHORT else 0

    def keep(self, nodes: list[int]) -> None:
        """Leaves only ``nodes``, in page order; a kept node's parents are kept."""
        new = {old: i for i, old in enumerate(nodes)}
        upto, n = [0] * (len(self.parent) + 1), 0
        for i in range(len(self.parent)):
            n += i in new
            upto[i + 1] = n
        self.end = [upto[self.end[i]] for i in nodes]
        self.parent = [new.get(self.parent[i], -1) for i in nodes]
        for c in self.__slots__:
            if c not in ("end", "parent"):
                col = getattr(self, c)
                setattr(self, c, [col[i] for i in nodes])


def _named(words: list[str]) -> int:
    """The groups of TOKENS that words name."""
    out = 0
    for w in words:
        g = _GROUP.get(w)
        if g is not None:
            out |= 1 << g
    return out


def _join_rows(page: Page) -> None:
    """Makes the cells of each row whose cells hold one line of inline text one text below the row."""
    row, cell = _TAG_ID["tr"], _TAG_ID["td"]
    gone: set[int] = set()
    for r in (i for i, t in enumerate(page.tag) if t == row):
        cells, texts, i = [], [], r + 1
        while i < page.end[r] and page.tag[i] == cell and page.end[i] <= i + 2:
            cells.append(i)
            if page.end[i] == i + 2:
                if page.texts[i + 1] is None or page.breaks[i + 1] or page.links[i + 1] > 1 and 2 * page.link_chars[i + 1] > page.chars[i + 1]:
                    break
                texts.append(i + 1)
            i = page.end[i]
        if i < page.end[r] or not texts:
            continue
        first = texts[0]
        total = lambda col: sum(col[i] for i in texts)  # noqa: B023, E731
        page.write(first, " ".join(page.texts[i] for i in texts), total(page.link_chars), total(page.inline), total(page.links), 0)
        page.parent[first], page.depth[first], page.end[first] = r, page.depth[r] + 1, first + 1
        page.above[first], page.within[first] = page.above[r] | page.groups[r], page.within[r]
        gone.update(cells, texts[1:])
    if gone:
        page.keep([i for i in range(len(page.parent)) if i not in gone])


def _groups(attrs: str) -> int:
    out = 0
    if attrs and ("=" in attrs):
        for m in _ATTR.finditer(attrs):
            for w in _SPLIT.split(m[1].lower()):
                g = _GROUP.get(w)
                if g is not None:
                    out |= 1 << g
    return out


def _ends(source: str, name: str) -> dict[int, int]:
    """Where a silent element ends, by where it starts; one without an end tag of its own is left out."""
    out: dict[int, int] = {}
    opened: list[int] = []
    unclosed: set[str] = set()
    at = 0
    while m := _MARKS[name].search(source, at):
        at = m.end()
        if m[1]:
            raw = m[1].lower()
            e = None if raw in unclosed else _END[raw].search(source, at)
            if e:
                at = e.end()
            else:
                unclosed.add(raw)
        elif m[2]:
            if opened:
                out[opened.pop()] = at
        elif m[3] and not (name == "svg" and m[0].endswith("/>")):
            opened.append(m.start())
    return out


def read(source: str | None) -> Page:
    """Reads a page of any quality; a null page has no nodes."""
    page = Page()
    if not source:
        return page
    stack: list[tuple[str, int]] = [("html", page.add(-1, "html", 0))]
    text: list[str] = []
    link, linked, tags, links, breaks = 0, 0, 0, 0, 0
    ends: dict[str, dict[int, int]] = {}

    def flush() -> None:
        nonlocal linked, tags, links, breaks
        if text:
            t = " ".join("".join(text).split())
            text.clear()
            if t:
                i = page.add(stack[-1][1], "text", 0)
                page.write(i, t, linked, tags, links, breaks)
                page.end[i] = i + 1
        linked = tags = links = breaks = 0

    # how many elements of a name are on the stack: in all, and since the last cell began, which most end tags cannot leave
    opened: dict[str, int] = {}
    scopes: list[dict[str, int]] = [{}]

    def push(name: str, i: int) -> None:
        stack.append((name, i))
        opened[name] = opened.get(name, 0) + 1
        scopes[-1][name] = scopes[-1].get(name, 0) + 1
        if name in ("td", "th"):
            scopes.append({})

    def cut(k: int) -> None:
        """Ends the elements from place k of the stack on."""
        for name, i in reversed(stack[k:]):
            if name in ("td", "th"):
                scopes.pop()
            if i:
                opened[name] -= 1
                scopes[-1][name] -= 1
            page.end[i] = len(page.parent)
        del stack[k:]

    def pop(name: str) -> None:
        """Ends what an opening tag ends, up to a fence: the innermost such element; of cells and rows the outermost
        in the table."""
        names, cell = CLOSES[name], name in _CELLS
        here = opened if cell else scopes[-1]
        if not any(here.get(x) for x in names):
            return
        last = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                last = k
                if not cell:
                    break
            elif stack[k][0] in FENCE and not (cell and stack[k][0] != "table"):
                break
        if last is not None:
            cut(last)

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        upto = m.start() if m else n
        if upto > at:
            t = html.unescape(source[at:upto])
            text.append(t)
            if link:
                linked += len(t)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = m[1] or m[4]
        if name in SILENT:
            if not closing and name in RAW:
                e = _END[name].search(source, at)
                at = e.end() if e else n
            elif not closing and name != "head":  # what a head holds is silent by itself
                if name not in ends:
                    ends[name] = _ends(source, name)
                at = ends[name].get(m.start(), at)
            if name in BLOCK:
                flush()
            continue
        if name == "a":
            link = 0 if closing else 1
            links += link
        if name == "br":
            text.append(" ")
            breaks += 1
        if name not in BLOCK:
            tags += 1
            continue
        if closing and name != "p" and not (opened if name in _CELLS else scopes[-1]).get(name):
            continue  # it ends nothing, nor the text around it
        flush()
        if closing:
            if scopes[-1].get(name) or (name in _CELLS and opened.get(name)):
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
        else:
            if name in CLOSES:
                pop(name)
            if name == "html" or name == "body" and opened.get(name):
                continue
            i = page.add(stack[-1][1], name, _groups(m[3] or m[6] or ""))
            if name in VOID:
                page.end[i] = i + 1
            else:
                push(name, i)
        link = 0
    flush()
    cut(0)
    if _TAG_ID["tr"] in page.tag:
        _join_rows(page)
    return page


def heading_like(tag: np.ndarray) -> np.ndarray:
    return np.isin(tag, [_TAG_ID[f"h{i}"] for i in range(1, 7)])


FEATURES = [
    "tag", "parent_tag", "grand_tag", "depth", "chars", "words", "stop_rate", "link_rate", "sub_chars", "sub_blocks", "sub_nodes", "sub_link_rate", "sub_words_block", "density", "share",
    "siblings", "place", "from_end", "prev_chars", "next_chars", "prev_link", "next_link", "page_place", "parent_sub_chars", "parent_link_rate", "inline_rate", "kin", "heading_before",
    *(f"own_{i}" for i in range(len(TOKENS))), *(f"above_{i}" for i in range(len(TOKENS))), *(f"says_{i}" for i in range(len(TOKENS))), *(f"parent_says_{i}" for i in range(len(TOKENS))),
    "page_chars", "prev_sub_words", "next_sub_words", "warns", "sub_warns", "sub_warn_rate", "prev_warns", "sub_links",
    *(f"in_{t}" for t in WITHIN), "great_tag", "grand_link_rate", "great_link_rate", "grand_words_block", "great_words_block", "parent_prev_words", "parent_heading_before",
]


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(depth) else []


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes, their parents as row numbers (-1: none), and their depths."""
    sizes = [len(p.parent) for p in pages]
    base = np.concatenate(([0], np.cumsum(sizes)))
    n = int(base[-1])
    cat = lambda k: np.array([x for p in pages for x in getattr(p, k)], np.int64)
    parent = cat("parent")
    own_page = np.repeat(np.arange(len(pages)), sizes)
    parent = np.where(parent >= 0, parent + base[own_page], -1)
    tag, groups, chars, links, words, stops, inline, warns, anchors = (cat(k) for k in ("tag", "groups", "chars", "link_chars", "words", "stops", "inline", "warns", "links"))
    depth, above, says, within = (cat(k) for k in ("depth", "above", "says", "within"))
    end = cat("end") + base[own_page]
    # the nodes below a node follow it, so their sums are differences of running sums
    run = np.zeros((n + 1, 7), np.int64)
    np.cumsum(np.stack([chars, links, words, (tag == 0).astype(np.int64), np.ones(n, np.int64), warns, anchors], 1), axis=0, out=run[1:])
    sub = run[end] - run[:-1]
    up = np.maximum(parent, 0)
    total = sub[base[:-1][np.array(sizes) > 0]] if n else sub
    page_row = np.cumsum(np.array(sizes) > 0) - 1
    total = total[page_row[own_page]] if n else total
    kids = np.zeros(n, np.int64)
    np.add.at(kids, parent[parent >= 0], 1)
    by = np.lexsort((np.arange(n), parent, own_page))
    same = np.zeros(n, bool)
    same[1:] = (parent[by][1:] == parent[by][:-1]) & (own_page[by][1:] == own_page[by][:-1])
    place = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    prev, nxt, rank = np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)
    rank[by] = place
    prev[by[1:]] = np.where(same[1:], by[:-1], -1)
    nxt[by[:-1]] = np.where(same[1:], by[1:], -1)
    rate = lambda a, b: a / np.maximum(b, 1)
    of = lambda x, i: np.where(i >= 0, x[np.maximum(i, 0)], -1)
    sub_link = rate(sub[:, 1], sub[:, 0])
    # what a node says: a text its own words; an element those of the texts among its first few nodes
    said = says.copy()
    for ahead in range(1, 4):
        at = np.arange(n) + ahead
        inside = at < end
        said[inside] |= says[at[inside]]
    said[prev >= 0] |= np.where(heading_like(tag)[prev[prev >= 0]], said[prev[prev >= 0]], 0)
    near = np.where(parent >= 0, said[up], 0) | np.where(parent[up] >= 0, said[np.maximum(parent[up], 0)], 0)
    heading = heading_like(tag)
    grand = of(parent, parent)
    great, words_block = of(parent, grand), rate(sub[:, 2], sub[:, 3])
    key = np.where(parent >= 0, parent, -1 - own_page) * len(TAGS) + tag
    _, at, cnt = np.unique(key, return_inverse=True, return_counts=True)
    cols = [
        tag, of(tag, parent), of(tag, of(parent, parent)), depth, chars, words, rate(stops, words), rate(links, chars), sub[:, 0], sub[:, 3], sub[:, 4], sub_link,
        rate(sub[:, 2], sub[:, 3]), rate(sub[:, 0], sub[:, 4]), rate(sub[:, 0], total[:, 0]), of(kids, parent), rank, of(kids, parent) - rank, of(sub[:, 0], prev), of(sub[:, 0], nxt), of(sub_link, prev), of(sub_link, nxt),
        rate(np.arange(n) - base[own_page], np.array(sizes)[own_page]), sub[up, 0], sub_link[up], rate(inline, words), cnt[at], of(heading.astype(np.int64), prev),
        *((groups >> i) & 1 for i in range(len(TOKENS))), *(((above & ~groups) >> i) & 1 for i in range(len(TOKENS))), *((said >> i) & 1 for i in range(len(TOKENS))), *((near >> i) & 1 for i in range(len(TOKENS))),
        total[:, 0] if n else chars, of(rate(sub[:, 2], sub[:, 3]), prev), of(rate(sub[:, 2], sub[:, 3]), nxt), warns, sub[:, 5], rate(sub[:, 5], sub[:, 3]), of(sub[:, 5], prev), sub[:, 6],
        *((within >> i) & 1 for i in range(len(WITHIN))), of(tag, great), of(sub_link, grand), of(sub_link, great), of(words_block, grand), of(words_block, great), of(words_block, of(prev, parent)), of(heading.astype(np.int64), of(prev, parent)),
    ]
    return np.stack(cols, 1).astype(np.float32) if n else np.zeros((0, len(FEATURES)), np.float32), parent, depth
