"""Operator 1: benchmark decontamination by the q-gram lemma.

An item of n characters that stands in a document with at most k edits shares at least n - q + 1 - k * q q-grams with it,
all on diagonals (document place minus item place) no more than k apart. So shared q-grams are counted in overlapping
diagonal bands, bands that reach the bound are kept, and a banded alignment decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, texts

#: Characters of a gram: for items of SHORT characters or more, and for shorter ones, whose edits leave too few long grams.
Q, SHORT_Q, SHORT = 8, 5, 32
#: Edits allowed for each character of an item.
RATE = 0.1
#: Items of fewer normal characters are found without edits alone, as whole words; under Q, as a whole document.
MIN_CHARS = 24
#: Characters of benchmark that are sent to the executors at once; a larger benchmark goes block by block.
BLOCK_CHARS = 1_000_000
#: Characters of documents that are searched at once; a longer document is searched in overlapping parts.
PART = 1 << 20
#: Places of an item's grams in a document that are expanded at once.
HITS = 1 << 20
_ASCII = bytes(x + 32 if 65 <= x <= 90 else x if x > 127 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def normal(text: str) -> str:
    """Lower-case text with each run of ASCII white space and punctuation as one space, none at its ends."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(_ASCII), np.uint8)
    space = raw == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    return raw[keep].tobytes().strip(b" ").decode("utf-8", "surrogatepass")


def codes(text: str) -> np.ndarray:
    """The text's characters as numbers; none of a normal text is 0."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def budget(n: int, rate: float = RATE) -> int:
    """Edits allowed in an item of n characters. From MIN_CHARS on the lemma's bound stays above zero for all of them."""
    return int(rate * n) if n >= MIN_CHARS else 0


def grams(raw: np.ndarray, q: int = Q) -> np.ndarray:
    """The q characters from each place as one number. Different grams may have one number: that adds candidates, which
    the alignment judges."""
    n = len(raw) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, x = np.zeros(n, np.uint64), raw.astype(np.uint64)
    for o in range(q):
        out *= _BASE
        out += x[o : o + n]
    return out


class Index:
    """The q-grams of a block of items with their places."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q):
        self.q = q
        self.ids = [i for i, _ in items]
        self.raw = [codes(x) for _, x in items]
        self.n = np.array([len(x) for x in self.raw], np.int64)
        self.k = np.array([budget(n) for n in self.n.tolist()], np.int64)
        self.bound = self.n - q + 1 - self.k * q
        parts = [grams(x, q) for x in self.raw]
        every = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        place = np.concatenate([np.arange(len(x)) for x in parts]) if parts else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.grams, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.item, self.place = item[order], place[order]
        self.most = int(self.n.max(initial=0))
        self.seen = None

    def known(self, g: np.ndarray) -> np.ndarray:
        """The places in g whose gram some item has."""
        if self.seen is None:
            self.shift = np.uint64(64 - max(16, int(math.log2(len(self.grams) + 1)) + 5))
            self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
            self.seen[(self.grams * _MIX >> self.shift).astype(np.int64)] = True
        at = np.flatnonzero(self.seen[(g * _MIX >> self.shift).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        right = self.grams[where] == g[at]
        return at[right], where[right]


_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def search(index: Index, docs: list[str]) -> list[tuple[int, int, int, int]]:
    """(document, item, start in the normal text, edits) of each item in each document: its best place."""
    if not len(index.grams):
        return []
    overlap = 2 * index.most + 2 * index.q
    whole = [codes(x) for x in docs]
    parts = [(d, at, x[at : at + PART + overlap]) for d, x in enumerate(whole) for at in range(0, max(1, len(x) - overlap), PART)]
    found: dict[tuple[int, int], tuple[int, int]] = {}
    batch, size = [], 0
    for p in [*parts, None]:
        if batch and (p is None or size + len(p[2]) > 2 * PART):
            for (d, i), got in _search(index, batch):
                if (d, i) not in found or got < found[d, i]:
                    found[d, i] = got
            batch, size = [], 0
        if p:
            batch.append(p)
            size += len(p[2]) + index.q
    return [(d, i, start, edits) for (d, i), (edits, start) in sorted(found.items())]


class Short:
    """Items under MIN_CHARS, by their number of words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.whole: dict[str, list[int]] = {}
        self.words: dict[int, dict[str, list[int]]] = {}
        for i, x in items:
            (self.whole if len(x) < Q else self.words.setdefault(x.count(" ") + 1, {})).setdefault(x, []).append(i)

    def search(self, doc: str) -> list[tuple[int, int]]:
        """(item, start in the normal text) of each item in a document: its first place."""
        out = [(i, 0) for i in self.whole.get(doc, ())]
        words = doc.split(" ") if self.words else []
        for n, items in self.words.items():
            start, seen = 0, set()
            for a in range(len(words) - n + 1):
                if (x := " ".join(words[a : a + n])) in items and x not in seen:
                    seen.add(x)
                    out += [(i, start) for i in items[x]]
                start += len(words[a]) + 1
        return out


def _search(index: Index, parts: list[tuple[int, int, np.ndarray]]):
    q, gap = index.q, np.zeros(index.q, "<u4")
    buffer = np.concatenate([y for *_, x in parts for y in (x, gap)])
    begins = np.cumsum([0] + [len(x) + q for *_, x in parts])[:-1]
    at, where = index.known(grams(buffer, q))
    if not len(at):
        return
    times = index.first[where + 1] - index.first[where]
    # bands are two steps wide and one apart, so diagonals up to a step apart share one
    spread = (PART + 4 * index.most + 4 * q + 64) + 2
    keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
    # a repeated gram meets each of an item's repeats, so places are taken by slices of HITS; bands of slices add up
    cuts = np.searchsorted(np.cumsum(times), np.arange(0, int(times.sum()), HITS), "left")
    for a, b in zip(cuts, [*cuts[1:], len(at)]):
        if a == b:
            continue
        t, w = times[a:b], where[a:b]
        hit = np.repeat(index.first[w], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        item, place, x = index.item[hit], index.place[hit], np.repeat(at[a:b], t)
        part = np.searchsorted(begins, x, "right") - 1
        band = (x - begins[part] - place + index.most) // (index.k[item] + 1)
        key = (part * len(index.n) + item) * spread + band
        some, m = np.unique(np.concatenate((key, key - 1)), return_counts=True)
        keys, of = np.unique(np.concatenate((keys, some)), return_inverse=True)
        n = np.bincount(of, np.concatenate((n, m)), len(keys)).astype(np.int64)
    keep = n >= index.bound[keys // spread % len(index.n)]
    keys = keys[keep]
    pair, band = np.divmod(keys, spread)
    part, item = np.divmod(pair, len(index.n))
    step = index.k[item] + 1
    low = band * step - index.most
    for i in np.unique(item):
        mine = np.flatnonzero(item == i)
        rows = max(1, min(256, (1 << 22) // (5 * len(index.raw[i]))))  # bounds the memory of a long item
        for s in range(0, len(mine), rows):
            some = mine[s : s + rows]
            for j, (edits, start) in zip(some, _align(index.raw[i], int(index.k[i]), [parts[p][2] for p in part[some]], low[some])):
                if edits <= index.k[i]:
                    d, offset, _ = parts[part[j]]
                    yield (d, int(i)), (int(edits), offset + int(start))


def _align(item: np.ndarray, k: int, docs: list[np.ndarray], low: np.ndarray) -> list[tuple[int, int]]:
    """Fewest edits between the item and a piece of each document that starts on diagonals low - k .. low + 3k + 1, and
    where about that piece starts. Cell [c, j] of a row stands for document c's place row + low + j."""
    n, width = len(item), 4 * k + 3
    low = low - k
    text = np.zeros((len(docs), n + width), np.uint32)
    for c, (x, a) in enumerate(zip(docs, low.tolist())):
        piece = x[max(a, 0) : max(a + n + width, 0)]
        text[c, max(0, -a) : max(0, -a) + len(piece)] = piece
    kind = np.int16 if width < 1 << 14 else np.int32
    far = kind(k + 1)
    row = np.zeros((len(docs), width), kind)
    steps = np.arange(width, dtype=kind)
    for r in range(n):
        if r % 64 == 63 and row.min() > k:
            break
        # diagonal j goes on from j (a letter against a letter), from j + 1 (a letter of the item left out)
        new = row + (text[:, r : r + width] != item[r])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        # and from j - 1 in the same row (a letter of the document left out)
        row = np.minimum(np.minimum.accumulate(new - steps, axis=1) + steps, far)
    best = row.argmin(axis=1)
    return [(int(row[c, b]), max(0, int(low[c]) + int(b))) for c, b in enumerate(best)]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, start, edits): each document with each item that stands in it with at most RATE edits a character,
    and the best place, in the normal text.

    Null texts and items hold nothing; items under MIN_CHARS normal characters have to stand there as whole words without
    an edit, those under Q as the whole document; an item or document may be of any length; equal rows give equal rows,
    and rows of one id their own; null ids stay null; an empty side gives none. The benchmark is searched for in blocks of about BLOCK_CHARS characters, so what an
    executor is sent doesn't grow with it; the documents are read once for each block and never shuffled.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    rows, sc = texts(docs, id_col, text_col), docs.sparkSession.sparkContext
    found = None
    for b in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        block = [(r["item"], x) for r in some.toLocalIterator() if (x := normal(r["text"]))]
        indexes = [Index([x for x in block if len(x[1]) >= SHORT]), Index([x for x in block if MIN_CHARS <= len(x[1]) < SHORT], SHORT_Q)]
        mine = _one_block(rows, sc.broadcast((indexes, Short([x for x in block if len(x[1]) < MIN_CHARS]))))
        found = mine if found is None else found.unionByName(mine)
    return found


def _one_block(rows: DataFrame, index) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("start", pa.int64()), ("edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                indexes, short = index.value
                raw = [normal(x) for x in part.column(1).to_pylist()]
                got = [(d, found.ids[i], start, edits) for found in indexes for d, i, start, edits in search(found, raw)]
                got += [(d, i, start, 0) for d, x in enumerate(raw) for i, start in short.search(x)]
                if got:
                    ids = part.column(0).to_pylist()
                    columns = ([ids[d] for d, *_ in got], [i for _, i, *_ in got], [s for *_, s, _ in got], [e for *_, e in got])
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)

    return rows.mapInArrow(run, "id long, item long, start long, edits int")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """docs without the documents that hold an item; columns, order and repeated rows stay. A row without an id can't be
    told from others without one, so it stays."""
    bad = contaminated(docs, benchmark, id_col, text_col, **names).select(F.col("id").alias("__bad")).distinct()
    return docs.join(bad, docs[id_col] == bad["__bad"], "left_anti")
