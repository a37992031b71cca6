"""Operator 10: token counts that follow edits.

A document is cut into leaves of pieces that are encoded alone as they are in their place, and a segment tree keeps the
sums of their characters and tokens. A piece ends before a lone space; what is long is cut where pre-tokens end, and a long
pre-token, such as a run of letters of a script without spaces, between two characters whose neighbouring bytes no token
holds. An edit finds the leaves it touches by the character sums, joins them with neighbours until cutting the text anew
around its ends gives cuts there too, encodes that region alone and updates the sums on the way to the root. Trees are rows of a table, so they are kept between
rounds of edits and no text is encoded anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, texts
from .token_ids import pieces

#: Pieces (words, mostly) of a leaf, and characters from which a piece is cut further and a leaf is full.
LEAF, LONG, LEAF_CHARS = 32, 64, 256
#: Characters on either side of a border, not all white space, that settle whether pre-tokens end there.
AROUND = 8
#: Personal data and secrets that scrub() replaces: e-mail addresses, network addresses, long numbers with separators.
SCRUB = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+?\d[\d ().-]{7,}\d"


class Counter:
    """Token counts of pieces, kept for pieces already seen."""

    def __init__(self, path: str, keep: int = 500_000):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.seen, self.keep = {}, keep
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.joined = {pair for token in ranks for pair in zip(token, token[1:])}

    def fine(self, text: str) -> Iterator[str]:
        """Pre-tokens of a text that begins where one does, long ones of letters in parts that no token spans."""
        for x in self.pattern.findall(text):
            if len(x) <= LONG:
                yield x
                continue
            raw, start, at = x.encode("utf-8", "surrogatepass"), 0, 0
            for k, c in enumerate(x):
                if k > start and (raw[at - 1], raw[at]) not in self.joined and x[k - 1].isalpha() and c.isalpha():
                    yield x[start:k]
                    start = k
                at += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            yield x[start:]

    def cut(self, text: str) -> list[str]:
        """The text in pieces that are encoded alone as they are in it."""
        return [y for x in pieces(text) for y in ([x] if len(x) <= LONG else self.fine(x))]

    def cuts_between(self, left: str, right: str) -> bool:
        """Whether a leaf may end between the two, of which the left one begins where a pre-token does: after white space it
        may not, as that is cut by what follows it."""
        if left[-1].isspace():
            return False
        if right[:1] == " " and right[1:2].strip():
            return True
        at, whole = 0, left + right
        for x in self.pattern.findall(whole):
            at += len(x)
            if at >= len(left):
                break
        if at == len(left):
            return True
        a, b = left[-1].encode("utf-8", "surrogatepass")[-1], right[0].encode("utf-8", "surrogatepass")[0]
        return (a, b) not in self.joined and left[-1].isalpha() and right[0].isalpha()

    def __call__(self, ps: list[str]) -> int:
        seen, n = self.seen, 0
        for p in ps:
            got = seen.get(p)
            if got is None:
                if len(seen) >= self.keep:
                    seen.clear()
                got = seen[p] = len(self.encode(p))
            n += got
        return n


def counter(path: str) -> Counter:
    return held(f"counter {path}", lambda: Counter(path))


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tree:
    """Leaves of a text with a segment tree over their characters and tokens."""

    def __init__(self, text: str, count: Counter, leaf: int = LEAF):
        self.count, groups, size = count, [[]], 0
        for p in count.cut(text):
            full = len(groups[-1]) >= leaf or size + len(p) > LEAF_CHARS
            if groups[-1] and full and not groups[-1][-1][-1].isspace():  # white space is cut by what follows it
                groups.append([])
                size = 0
            groups[-1].append(p)
            size += len(p)
        self.leaves = ["".join(g) for g in groups]
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (x, g) in enumerate(zip(self.leaves, groups)):
            self.chars[self.size + i], self.tokens[self.size + i] = len(x), count(g)
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.tokens[i] = (x[2 * i] + x[2 * i + 1] for x in (self.chars, self.tokens))
        self.encoded = 0

    @classmethod
    def kept(cls, leaves: list[str], chars: list[int], tokens: list[int], count: Counter) -> Tree:
        """A tree as a row of trees() has it."""
        tree = cls.__new__(cls)
        tree.count, tree.leaves, tree.chars, tree.tokens, tree.size, tree.encoded = count, leaves, chars, tokens, len(chars) // 2, 0
        return tree

    def at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last for the text's end), and the place of the leaf's first."""
        i, first = 1, 0
        char = min(char, max(self.chars[1] - 1, 0))
        while i < self.size:
            i *= 2
            if char >= first + self.chars[i]:
                first += self.chars[i]
                i += 1
        return i - self.size, first

    def _put(self, leaf: int, text: str) -> None:
        i = self.size + leaf
        self.leaves[leaf] = text
        self.chars[i], self.tokens[i] = len(text), self.count(self.count.cut(text)) if text else 0
        self.encoded += len(text)
        while i > 1:
            i //= 2
            self.chars[i], self.tokens[i] = (x[2 * i] + x[2 * i + 1] for x in (self.chars, self.tokens))

    def _around(self, leaves: range) -> str:
        """The text of leaves, one after the other, until AROUND characters, not all white space, are there."""
        out = ""
        for i in leaves:
            out = out + self.leaves[i] if leaves.step > 0 else self.leaves[i] + out
            if len(out) >= AROUND and out.strip():
                break
        return out

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts new in the place of characters start to end (end not included), as they are now."""
        (lo, first), (hi, _) = self.at(start), self.at(max(start, end - 1))
        text = "".join(self.leaves[lo : hi + 1])
        self.leaves[lo], lone = text[: start - first] + new + text[end - first :], range(lo + 1, hi + 1)
        for i in lone:
            self.leaves[i] = ""
        top = len(self.leaves) - 1
        # context: neighbours join the region until pieces end at both its borders
        left, right = lo, hi
        while True:
            before, after = self._around(range(left - 1, -1, -1)), self._around(range(right + 1, top + 1))
            here = self.leaves[lo]
            if before and not (here and self.count.cuts_between(before, here + after)):
                left = next(i for i in range(left - 1, -1, -1) if self.leaves[i])
                self.leaves[lo], self.leaves[left] = self.leaves[left] + here, ""
            elif after and not (here and self.count.cuts_between(before + here, after)):
                right = next(i for i in range(right + 1, top + 1) if self.leaves[i])
                self.leaves[lo], self.leaves[right] = here + self.leaves[right], ""
            else:
                break
        for i in range(left, right + 1):
            if i != lo and (self.chars[self.size + i] or self.leaves[i]):
                self._put(i, self.leaves[i])
        self._put(lo, self.leaves[lo])

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)


_TREE = [("id", pa.int64()), ("leaves", pa.list_(pa.string())), ("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))]
_FIELDS = "id long, leaves array<string>, chars array<long>, tokens array<long>"


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(id, leaves, chars, tokens) of each text: its leaves in order, and the sums of their characters and tokens as a tree
    in an array: the root at 1, the children of i at 2i and 2i + 1. A null text is the empty one; equal rows give equal
    rows; null ids stay null; no rows give none; other columns, whatever their names, play no part."""
    path, schema = ranks or default_ranks(), pa.schema(_TREE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [Tree(x, count) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([getattr(t, n) for t in made], k) for n, k in _TREE[1:])], schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(run, _FIELDS)


def text_of() -> Column:
    """The text of a row of trees()."""
    return F.array_join("leaves", "")


def edited(kept: DataFrame, edits: Column, ranks: str | None = None) -> DataFrame:
    """Rows of trees() after their edits, to be kept for the next ones, with n_tokens (before), n_edits and encoded_again,
    the characters that were encoded for them.

    edits: array<struct<start, end, text>> on kept, places in the text before any edit, in order and apart; null and the
    empty array leave a text as it is.
    """
    path = ranks or default_ranks()
    schema = pa.schema([*_TREE, *((x, pa.int64()) for x in ("n_tokens", "n_edits", "encoded_again"))])
    rows = kept.select("id", "leaves", "chars", "tokens", edits.alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), []
                for leaves, chars, tokens, changes in zip(*(part.column(k).to_pylist() for k in range(1, 5))):
                    tree, changes = Tree.kept(leaves, chars, tokens, count), changes or []
                    before = tree.n_tokens
                    for c in reversed(changes):  # from the end, so that places hold
                        tree.edit(c["start"], c["end"], c["text"] or "")
                    out.append((tree.leaves, tree.chars, tree.tokens, before, len(changes), tree.encoded))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(x), t) for x, t in zip(zip(*out), schema.types[1:]))], schema=schema)

    return rows.mapInArrow(run, f"{_FIELDS}, n_tokens long, n_edits long, encoded_again long")


def counted(after: DataFrame) -> DataFrame:
    """(id, n_tokens, n_edits, tokens_after, chars_after, encoded_again) of rows of edited(): counts before and after."""
    return after.select("id", "n_tokens", "n_edits", F.get("tokens", F.lit(1)).alias("tokens_after"), F.get("chars", F.lit(1)).alias("chars_after"), "encoded_again")


def with_edits(kept: DataFrame, edits: DataFrame, id_col: str = "id", column: str = "edits") -> DataFrame:
    """kept with a column of edits from a table edits(id, start, end, text), in order; edits of a null id go to rows of a
    null id. ValueError if kept has such a column."""
    if column in kept.columns:
        raise ValueError(f"there is a column {column} already; name another")
    each = edits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("edits"))
    return kept.alias("k").join(each.alias("e"), F.col(f"k.{id_col}").eqNullSafe(F.col("e.id")), "left").select("k.*", F.col("e.edits").alias(column))


def scrub(text: Column, pattern: str = SCRUB, mark: str = "<private>") -> Column:
    """The edits that put a mark in the place of each match of the pattern: array<struct<start, end, text>>."""
    import re

    rx = re.compile(pattern)

    @F.pandas_udf("array<struct<start: long, end: long, text: string>>")
    def udf(x):
        return x.map(lambda t: [{"start": m.start(), "end": m.end(), "text": mark} for m in rx.finditer(t or "")])

    return udf(F.coalesce(text, F.lit("")))
