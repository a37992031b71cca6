"""Operator 7: main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of element and text nodes; each node gets features of its subtree, its attribute tokens, its
depth and its siblings; boosted trees give the probability that it belongs to the main text; and the likeliest labelling
in which no node below a rejected one is kept is found bottom-up.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin

#: At most so many pages, chosen by the hash of their id, train the model, and of each so many nodes, evenly thinned out.
MAX_TRAINING_PAGES, MAX_TRAINING_NODES = 200, 20_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
#: Elements inside a block, at which a word or line of it doesn't end.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br text".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Tags whose end the start of another implies.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table td th ul ol dl article section div body html main aside nav form button object".split())

#: Tags and attribute tokens that speak for and against the main text in labels and features.
MAIN_TAGS = frozenset("article main".split())
MAIN_TOKENS = frozenset("article body-text content entry entry-content main main-content maincontent post post-body post-content story story-body text articlebody article-body page-content".split())
OTHER_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg button select menu dialog head title textarea label".split())
OTHER_TOKENS = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus feedback foot footer form head header hidden login masthead menu menubar meta-nav modal nav navbar navigation newsletter notice notices notification pager pagination popup popular promo promoted promotion reader-comments recommended related replies reply respond responses search share sharing sidebar sidebar-left sidebar-right signup site-footer site-header skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar widget widgets".split())

OTHER_PREFIXES = frozenset("ad ads advert comment comments cookie footer nav promo share sidebar".split())

_MARKING = sorted(OTHER_TOKENS - {"head", "header", "text"})

_OPEN, _PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)"), re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW_END = {t: re.compile(rf"</{t}(?![^\s/>])", re.I) for t in RAW}


def _tags(source: str) -> Iterator[tuple[int, int, str | None, str, str]]:
    """(start, end, name, what stands in it, its first characters) of each tag; comments, declarations and the like have no
    name. A quote that never closes is a plain character, which is found out once, so the time is linear."""
    at, n, closes = 0, len(source), {'"': True, "'": True}

    def past(mark: str, start: int) -> int:
        found = source.find(mark, start)
        return found + len(mark) if found >= 0 else n

    while (i := source.find("<", at)) >= 0:
        head = source[i : i + 9]
        if head.startswith("<!--"):
            at = past("-->", i + 4)
            yield i, at, None, "", head
        elif head == "<![CDATA[":
            at = past("]]>", i + 9)
            yield i, at, None, source[i + 9 : at - 3], head
        elif head[1:2] in ("!", "?"):
            at = past(">", i + 2)
            yield i, at, None, "", head
        elif (m := _OPEN.match(source, i)) is None:
            at = i + 1
        else:
            p = m.end()
            while (p := _PLAIN.match(source, p).end()) < n and (c := source[p]) != ">":
                q = source.find(c, p + 1) if closes[c] else -1
                closes[c] = q >= 0
                p = q + 1 if q >= 0 else p + 1
            at = min(p + 1, n)
            yield i, at, m[2].lower(), source[m.end() : p], "</" if m[1] else "<"


class Page:
    """A page's nodes in page order: parent, tag ("#text" for text) and, for text, what it says."""

    __slots__ = ("parent", "tag", "tokens", "said", "depth", "open")

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens, self.said, self.depth = [-1], ["#root"], [()], [""], [0]
        stack, at, n = [0], 0, len(source)
        self.open: Counter[str] = Counter()
        skip = 0
        for start, end, name, inner, head in _tags(source):
            if start < skip:  # inside an element whose content is no markup
                continue
            if start > at:
                self._text(stack[-1], source[at:start])
            at = end
            if name is None:
                if head == "<![CDATA[":
                    self._text(stack[-1], inner.replace("&", "&amp;"))
                continue
            if head == "</":
                self._close(stack, name)
                continue
            if name in CLOSES_P:
                self._imply(stack, {"p"}, SCOPES)
            elif name in IMPLIED:
                self._imply(stack, IMPLIED[name], SCOPES - IMPLIED[name] if name in ("td", "th") else SCOPES - {"td", "th"} if name == "tr" else SCOPES)
            node = self._add(stack[-1], name, self._tokens(inner) if inner else ())
            if name in RAW:
                close = _RAW_END[name].search(source, at)
                if name in ("textarea", "title"):
                    self._text(node, source[at : close.start() if close else n])
                tail = source.find(">", close.end()) if close else -1
                at = skip = tail + 1 if tail >= 0 else n
            elif name not in VOID and not inner.endswith("/"):
                stack.append(node)
                self.open[name] += 1
        if at < n:
            self._text(stack[-1], source[at:])

    def _pop(self, stack: list[int], k: int) -> None:
        for node in stack[k:]:
            self.open[self.tag[node]] -= 1
        del stack[k:]

    def _add(self, parent: int, tag: str, tokens: tuple, said: str = "") -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.said.append(said)
        self.depth.append(self.depth[parent] + 1)
        return len(self.tag) - 1

    def _text(self, parent: int, raw: str) -> None:
        if raw:
            self._add(parent, "#text", (), html.unescape(raw) if "&" in raw else raw)

    @staticmethod
    def _tokens(raw: str) -> tuple:
        out = []
        for m in _ATTRIBUTE.finditer(raw):
            key = m[1].lower()
            if key in ("class", "id", "role", "itemprop"):
                out += (html.unescape(m[2] or m[3] or m[4] or "")).lower().replace("_", "-").split()
            elif key == "aria-hidden" and (m[2] or m[3] or m[4]) == "true":
                out.append("hidden")
        return tuple(out) + (("hidden",) if re.search(r"(?:^|\s)hidden(?:\s|$)", raw) or "display:none" in raw.replace(" ", "") else ())

    def _close(self, stack: list[int], name: str) -> None:
        if not self.open[name]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                self._pop(stack, k)
                return
            if name in INLINE and self.tag[stack[k]] not in INLINE:
                return

    def _imply(self, stack: list[int], names: set, stops: frozenset) -> None:
        if not any(self.open[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in names:
                self._pop(stack, k)
                return
            if tag in stops:
                return


FEATURES = ("main above", "other above", "other here", "page has main", "depth", "is text", "log chars", "log tags", "chars a tag", "link share", "chars share of parent", "place", "siblings", "block parent", "paragraph", "heading", "list", "other tokens below", "punctuation")


@lru_cache(maxsize=65536)
def _says(tag: str, tokens: tuple) -> tuple[bool, bool]:
    """Whether a node's own tag or attribute tokens speak for and against the main text."""
    return tag in MAIN_TAGS or any(x in MAIN_TOKENS for x in tokens), tag in OTHER_TAGS or any(x in OTHER_TOKENS or x.split("-")[0] in OTHER_PREFIXES for x in tokens)


def describe(pages: list[Page], hide: str = "") -> np.ndarray:
    """FEATURES of each node of the pages. hide "main" or "other": as if no tag or token said so."""
    starts = np.cumsum([0] + [len(p.tag) for p in pages])
    tag = [t for p in pages for t in p.tag]
    parent = np.concatenate([np.maximum(p.parent, 0) + s for p, s in zip(pages, starts.tolist())])
    depth = np.concatenate([p.depth for p in pages])
    said = [_says(t, k) for p in pages for t, k in zip(p.tag, p.tokens)]
    main, other = np.array(said, bool).reshape(-1, 2).T.astype(np.float32)
    main, other = main * (hide != "main"), other * (hide != "other")
    n, rows = len(tag), np.arange(len(tag))
    code = np.array([_CODES.get(t, 0) for t in tag])
    is_text, inline, link = code == 1, (code & 2) > 0, (code & 4) > 0
    stripped = [x.strip() for p in pages for x in p.said]
    chars = np.array([len(x) for x in stripped], float)
    dots = np.array([x.count(".") + x.count(",") if x else 0 for x in stripped], float)
    # nodes stand in page order, so a subtree is a run of nodes
    ends = (rows + 1).tolist()
    up = parent.tolist()
    for i in range(n - 1, 0, -1):
        if ends[i] > ends[up[i]]:
            ends[up[i]] = ends[i]
    ends = np.array(ends)
    first = np.isin(rows, starts[:-1])
    ends[first] = starts[1:]
    linked = chars * is_text * (link[parent] | link[parent[parent]])
    sums = np.zeros((n + 1, 5))
    np.cumsum(np.stack((chars, linked, ~is_text, other, dots), axis=1), axis=0, out=sums[1:])
    s = sums[ends] - sums[:-1]
    # what stands above is found level by level
    main_above, other_above = main.copy(), np.zeros(n, np.float32)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
    for a, b in zip(cuts, cuts[1:]):
        level = order[a:b]
        main_above[level] = np.maximum(main[level], main_above[parent[level]])
        other_above[level] = np.maximum(other_above[parent[level]], other[parent[level]])
    kids = np.bincount(parent[~first], minlength=n)
    by_parent = np.lexsort((rows, parent + first * n))
    place = np.empty(n)
    place[by_parent] = np.arange(n) - np.searchsorted((parent + first * n)[by_parent], (parent + first * n)[by_parent])
    has_main = np.repeat(np.maximum.reduceat(main, starts[:-1]), np.diff(starts))
    siblings = kids[parent]
    columns = (
        main_above, other_above, other, has_main, depth, is_text, np.log1p(s[:, 0]), np.log1p(s[:, 2]), s[:, 0] / np.maximum(s[:, 2], 1), s[:, 1] / np.maximum(s[:, 0], 1), s[:, 0] / np.maximum(s[parent, 0], 1), place / np.maximum(siblings, 1), np.log1p(siblings), ~inline[parent], (code == 8) | (code[parent] == 8), code == 16, code == 32, np.log1p(s[:, 3]), s[:, 4] / np.maximum(s[:, 0], 1) * 20,
    )
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


_CODES = {t: 2 for t in INLINE} | {"#text": 1, "a": 2 | 4, "p": 8} | {f"h{i}": 16 for i in range(1, 7)} | {t: 32 for t in ("ul", "ol", "li")}


def weak_labels(page: Page) -> np.ndarray:
    """1 for text in a marked main part and under nothing that speaks against it, and for every node above such text."""
    main, other = zip(*[_says(t, k) for t, k in zip(page.tag, page.tokens)])
    n = len(page.tag)
    inside, out = [False] * n, np.zeros(n, np.int8)
    for i in range(1, n):
        inside[i] = (main[i] or inside[page.parent[i]]) and not other[i]
    for i in range(n - 1, 0, -1):
        if page.tag[i] == "#text" and inside[i]:
            out[i] = 1
        if out[i]:
            out[page.parent[i]] = 1
    return out


_PLACE, _OPEN_MAIN = re.compile(r"<(?:p|h[1-6]|ul|ol|div)\b[^>]*>", re.I), re.compile(r"<(?:article|main)\b[^>]*>", re.I)


def varied(source: str, seed: int, outside: bool) -> str:
    """The page with marked and unmarked blocks of its own words put among the blocks of its main part, and, if outside,
    unmarked ones before it. Pages of one make would else teach that length or a tag decides."""
    rng = random.Random(seed)
    start = _OPEN_MAIN.search(source)
    words = re.sub(r"<[^>]*>", " ", source[start.end() if start else 0 :]).split()
    if not start or not words:
        return source

    def said(most: int) -> str:
        i = rng.randrange(len(words))
        return html.escape(html.unescape(" ".join(words[i : i + rng.randint(1, most)])))

    def block(marked: bool) -> str:
        inner = "".join(f"<{t}>{said(3 if t[0] == 'h' else 40)}</{t}>" for t in rng.choices(("p", "div", "h2", "h3", "p", "blockquote", "pre"), k=rng.randint(1, 3)))
        inner = rng.choice((inner, inner, said(30), "<ul>" + "".join(f"<li>{said(12)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>", f'<p>{said(9)} <a href="/x">{said(9)}</a> {said(9)}</p>'))
        if not marked:
            return inner if inner[0] == "<" and rng.random() < 0.5 else f"<div>{inner}</div>"
        if rng.random() < 0.35:
            tag = rng.choice(("aside", "nav", "footer", "form", "header"))
            return f"<{tag}>{inner}</{tag}>"
        tag = rng.choice(("div", "section", "ul", "div"))
        return f'<{tag} {rng.choice(("class", "id"))}="{rng.choice(_MARKING)}">{inner}</{tag}>'

    out, at = [source[: start.start()]], start.start()
    if outside:
        out.append("".join(block(rng.random() < 0.4) for _ in range(rng.randint(1, 4))))
    for m in _PLACE.finditer(source, start.end()):
        if rng.random() < 0.15:
            out += [source[at : m.start()], block(rng.random() < 0.6)]
            at = m.start()
    return "".join((*out, source[at:]))


def lessons(source: str, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels from a page: with all marks, with those for and with those against the main text hidden."""
    out = []
    for text, hide in ((varied(source, seed, True), ""), (varied(source, seed + 1, False), "main"), (source, "other")):
        page = Page(text)
        y = weak_labels(page)
        if y.any():
            some = np.linspace(0, len(y) - 1, min(len(y), MAX_TRAINING_NODES)).astype(int)
            out.append((describe([page], hide)[some], y[some]))
    return out


class Boosted:
    """Boosted regression trees with logistic loss over binned features; trees of fixed depth as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 2.0):
        self.depth, self.trees = depth, []
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf, np.float32)
            for level in range(depth):
                first, m = 2**level - 1, 2**level
                best = np.full(m, 1e-9)
                chosen = np.full((m, 2), -1)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = len(c) + 1
                    gs, hs = (np.bincount(node * k + binned[:, f], w, m * k).reshape(m, k).cumsum(1) for w in (g, h))
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    at = gain.argmax(1)
                    better = gain[np.arange(m), at] > best * (1 + 1e-6)
                    best[better] = gain[np.arange(m), at][better]
                    chosen[better] = np.stack((np.full(m, f), at), 1)[better]
                for j, (f, at) in enumerate(chosen.tolist()):
                    if f >= 0:
                        feature[first + j], cut[first + j] = f, cuts[f][at]
                node = node * 2 + (x[np.arange(len(y)), feature[first + node]] > cut[first + node])
            leaf = rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge)
            self.trees.append((feature, cut, leaf))
            score += leaf[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


def decode(parent: list[int], score: np.ndarray) -> list[bool]:
    """Which nodes are kept in the likeliest labelling in which all below a rejected node is rejected.

    score: log odds of being kept. Against all rejected, keeping a node gains its log odds and the gains of those of
    its children that are worth it.
    """
    gain = score.tolist()
    for i in range(len(parent) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    kept = [gain[0] > 0] + [False] * (len(parent) - 1)
    for i in range(1, len(parent)):
        kept[i] = kept[parent[i]] and gain[i] > 0
    return kept


def blocks(page: Page, kept: list[bool]) -> str:
    """The kept text: white space inside a block as one space, blocks joined by a line feed."""
    # which block a node's text belongs to: that of the nearest element that isn't inline, anew after each block inside
    out, current, where = [], [], None
    n = len(page.tag)
    block = [0] * n
    for i in range(1, n):
        tag, p = page.tag[i], page.parent[i]
        if tag == "#text":
            if not kept[i]:
                continue
            if block[p] != where:
                if current:
                    out.append("".join(current))
                current, where = [], block[p]
            current.append(page.said[i])
        elif tag in INLINE:
            block[i] = block[p]
            if tag == "br" and kept[p]:
                current.append(" ")
        else:
            block[i] = i
            # text of the parent that follows is another block
            if where is not None and current:
                out.append("".join(current))
                current, where = [], None
    if current:
        out.append("".join(current))
    return "\n".join(x for x in (" ".join(b.split()) for b in out) if x)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_TRAINING_PAGES) -> Boosted | None:
    """Trees from at most max_pages pages that mark a main part; None without such pages. Each page counts three
    times, also with the marks for and those against the main text hidden, so that the trees know each alone."""
    # the bound on rows bounds what comes to the driver: features of nodes, no texts
    picked = pages.where(F.length(html_col) > 0).select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).orderBy(F.xxhash64("id"), "id").limit(max_pages)
    schema = pa.schema([("x", pa.binary()), ("y", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [x for i, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in lessons(source, i or 0)]
            xs, ys = [x.tobytes() for x, _ in got], [y.tobytes() for _, y in got]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], schema=schema)

    rows = picked.mapInArrow(run, "x binary, y binary").collect()
    if not rows:
        return None
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)) for r in rows])
    y = np.concatenate([np.frombuffer(r["y"], np.int8) for r in rows]).astype(float)
    return Boosted(x, y)


def main_text(source: str, model: Boosted | None) -> str:
    """The main text of one page; without a model the marks alone decide."""
    page = Page(source)
    if model is None:
        return blocks(page, weak_labels(page).astype(bool).tolist())
    return blocks(page, decode(page.parent, model.score(describe([page]))))


def extract(pages: DataFrame, model: Boosted | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of each page, of any length. Null and empty pages have the empty text; null ids and urls stay null;
    equal rows give equal rows and no rows none; other columns, whatever their names, play no part."""
    sent = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                parsed = [Page(x) for x in part.column(2).to_pylist()]
                if model is None:
                    out = [blocks(p, weak_labels(p).astype(bool).tolist()) for p in parsed]
                else:
                    scores = model.score(describe(parsed))
                    ends = np.cumsum([len(p.tag) for p in parsed])
                    out = [blocks(p, decode(p.parent, scores[e - len(p.tag) : e])) for p, e in zip(parsed, ends.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], schema=schema)

    return rows.mapInArrow(run, "id long, url string, text string")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of each page, by trees trained on a bounded sample of these pages."""
    return extract(pages, train(pages, id_col, html_col), id_col, url_col, html_col)
