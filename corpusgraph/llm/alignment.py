"""Operator 13: cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut the bytes of a text at places of their own. An interval of the text is split at a shared end near its
middle, which is looked for outwards from the middle by bisection in the other's ends, and both halves are split in turn;
an interval without a shared end is a group. Tokens of a group whose bytes overlap are links.

Both tokenizers cut before a lone space between two words, so a text is a row of parts that can be aligned alone; parts
that were seen are known. Where that doesn't hold of a tokenizer or a text, the whole text is one part.

What is counted over all documents are pairs of linked ids. Each document then needs the counts of its own pairs: those of
the HOT most frequent pairs, a number that doesn't grow, go to all tasks, and the others are joined.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, forget, held, stored, texts
from .token_ids import pieces

#: Pairs whose counts go to all tasks.
HOT = 100_000
_SPACE = "▁"
#: A space beside other white space; a text's first character is one too, as it follows the space that is put ahead.
_ODD_SPACE = re.compile(r" \s|\s |^\s")
_MARK = r"[.,;:!?*#$%&|]"


def groups_of(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """(first a, past a, first b, past b) of each group, in order; both lists ascend to the same end.

    Each interval knows which of its ends are still to be asked, so an end is asked once and the work is linear but for
    the bisection."""
    out, todo = [], [(0, len(ends_a), 0, len(ends_b), 0, len(ends_a) - 1)] if ends_a else []
    while todo:
        a0, a1, b0, b1, lo, hi = todo.pop()  # the ends from lo to hi, hi not included, may be shared
        left = right = (lo + hi) // 2
        cut = -1
        while left > lo or right < hi:
            if right < hi:
                j = bisect_left(ends_b, ends_a[right], b0, b1)
                if j < b1 and ends_b[j] == ends_a[right]:
                    cut, left_to, right_from = right, left, right + 1
                    break
                right += 1
            if left > lo:
                left -= 1
                j = bisect_left(ends_b, ends_a[left], b0, b1)
                if j < b1 and ends_b[j] == ends_a[left]:
                    cut, left_to, right_from = left, left, right
                    break
        if cut < 0:
            out.append((a0, a1, b0, b1))
        else:
            todo.append((cut + 1, a1, j + 1, b1, right_from, hi))
            todo.append((a0, cut + 1, b0, j + 1, lo, left_to))
    return out


def links_of(a0: int, a1: int, b0: int, b1: int, ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """The places of tokens of a group whose bytes overlap."""
    out, i, j = [], a0, b0
    while i < a1 and j < b1:
        out.append((i, j))
        x, y = ends_a[i], ends_b[j]
        i, j = i + (x <= y), j + (y <= x)
    return out


def _unbyte() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others, in order,
    for the characters from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class Pair:
    """A byte-level tokenizer A and a piece model B, which adds a space, with what is known of parts of texts."""

    def __init__(self, a_path: str, b_path: str, keep: int = 350_000, keep_chars: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _unbyte()
        self.a_bytes: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace(_SPACE, " ").encode() for k, x in enumerate(names)]
        self.a_size, self.b_size = [*map(len, self.a_bytes)], [*map(len, self.b_bytes)]
        made = json.loads(self.a.to_str())
        cut = made.get("pre_tokenizer") or {}
        self.in_parts = made["model"]["type"] == "BPE" and not made.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        # no piece goes on after a space that follows a word, so B cuts before such a space; likewise between words and marks
        plain = [x for k, x in enumerate(names) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))]
        self.in_parts &= not any(_SPACE in x.lstrip(_SPACE) for x in plain)
        # parts of a text of lone spaces: words, marks and line feeds that end where both cut, else all to the next space;
        # letters that some piece of B joins with a mark are in no such word
        joined = {x for p in plain for m in re.finditer(rf"(?=(\w){_MARK}|{_MARK}(\w))", p) for x in m.groups() if x}
        letter = rf"[^\W_{''.join(map(re.escape, sorted(joined)))}]"
        self.words = None
        if self.in_parts and not any("\n" in p for p in plain):
            self.words = re.compile(rf" ?{letter}+(?=[ \n]|{_MARK}|$)|{_MARK}+(?={letter}|[ \n]|$)|(?<=\S)\n(?=\S)| ?[^ ]+")
        self.keep, self.keep_chars = keep, keep_chars
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.chars = 0
        self.facts = np.empty((0, 3), np.int64)  # tokens of A, of B, groups
        self.text: list[str] = []
        self.keys: list[bytes] = []

    def aligned(self, text: str, a: list[int], b: list[int]) -> tuple[tuple[int, int, int], str, bytes] | None:
        """((tokens of A, of B, groups), the groups as text, the pairs of linked ids as 64-bit numbers), or None where the
        bytes of either aren't the text's."""
        raw = text.encode()
        if b"".join([self.a_bytes[k] for k in a]) != raw or b"".join([self.b_bytes[k] for k in b]) != raw:
            return None
        n, m, name = len(a), len(b), str
        if n == 1 or m == 1:  # one token is all of it
            return (n, m, 1), f"{','.join(map(name, a))}|{','.join(map(name, b))}", array("q", [i << 32 | j for i in a for j in b]).tobytes()
        ends_a, ends_b = list(accumulate([self.a_size[k] for k in a])), list(accumulate([self.b_size[k] for k in b]))
        said, keys, found = [], [], groups_of(ends_a, ends_b)
        for a0, a1, b0, b1 in found:
            if a1 - a0 == 1 == b1 - b0:
                said.append(f"{a[a0]}|{b[b0]}")
                keys.append(a[a0] << 32 | b[b0])
            else:
                said.append(f"{','.join(map(name, a[a0:a1]))}|{','.join(map(name, b[b0:b1]))}")
                keys += [a[i] << 32 | b[j] for i, j in links_of(a0, a1, b0, b1, ends_a, ends_b)]
        return (n, m, len(found)), ";".join(said), array("q", keys).tobytes()

    def encoded(self, parts: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """B adds a space to what it is given, so it is given parts without theirs, and those that have none after a line
        feed, which is a token of its own."""
        for at in range(0, len(parts), 5_000):
            some = parts[at : at + 5_000]
            ids = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in some], num_threads=1)
            yield from zip(some, [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)], [x if p[0] == " " else x[2:] for p, x in zip(some, ids)])

    def learn(self, parts: set[str]) -> None:
        facts = []
        for part, a, b in self.encoded([p for p in parts if p not in self.code]):
            got = self.aligned(part, a, b)
            self.code[part] = -1 if got is None else len(self.text)
            if got is not None:
                self.chars += len(part)
                facts.append(got[0])
                self.text.append(got[1])
                self.keys.append(got[2])
        if facts:
            known = len(self.text) - len(facts)
            if len(self.text) > len(self.facts):
                self.facts = np.concatenate([self.facts[:known], np.zeros((known + 2 * len(facts), 3), np.int64)])
            self.facts[known : len(self.text)] = facts

    def parts(self, text: str) -> list[str]:
        """A space and the text, in parts that both tokenizers encode alone as they do in their place."""
        if not self.in_parts:
            return [" " + text]
        lone = bool(text) and text[-1] != " " and not _ODD_SPACE.search(text)
        return self.words.findall(" " + text) if lone and self.words else pieces(" " + text)

    def documents(self, docs: list[str]) -> list[tuple]:
        """(tokens of A, of B, groups, links, digest of the groups, different pairs, their times) of each text."""
        if len(self.code) > self.keep or self.chars > self.keep_chars:
            self.clear()
        split = [self.parts(t) for t in docs]
        self.learn({p for t, ps in zip(docs, split) if t for p in ps})
        out, facts = [], self.facts
        for text, parts in zip(docs, split):
            codes = [*map(self.code.__getitem__, parts)] if text else []
            counts, said, keys, times = (0, 0, 0), None, b"", 1
            if codes and min(codes) >= 0:
                once, times = np.unique(np.array(codes), return_counts=True)
                counts, said = (facts[once] * times[:, None]).sum(0).tolist(), ";".join(map(self.text.__getitem__, codes))
                keys = [self.keys[c] for c in once.tolist()]
                times, keys = np.repeat(times, [len(k) // 8 for k in keys]), b"".join(keys)
            elif len(parts) > 1:  # a part's bytes differ: so will the text's, or else it is aligned whole
                got = self.aligned(*next(self.encoded([" " + text])))
                counts, said, keys = got or (counts, said, keys)
            pairs, where = np.unique(np.frombuffer(keys, np.int64), return_inverse=True)
            n_times = np.bincount(where, np.broadcast_to(times, len(where)), len(pairs)).astype(np.int64)
            out.append((*counts, int(n_times.sum()), "" if said is None else hashlib.sha256(said.encode()).hexdigest(), pairs, n_times))
        return out


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_FIELDS = [("uid", pa.int64()), ("id", pa.int64()), *((x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
_DDL = "uid long, id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def _documents(rows: DataFrame, tokenizers: tuple[str, str]) -> DataFrame:
    schema = pa.schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = held(f"pair {tokenizers}", lambda: Pair(*tokenizers))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                uids, ids, docs = (c.to_pylist() for c in batch.slice(at, 64).columns)
                columns = uids, ids, *map(list, zip(*pair.documents(docs)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)

    return rows.select("uid", "id", "text").mapInArrow(run, _DDL)


def _with_hot(made: DataFrame, hot: DataFrame) -> DataFrame:
    """made with the sums over its hot pairs, and the other pairs left."""
    got = hot.orderBy("pair").toPandas()
    known = made.sparkSession.sparkContext.broadcast((got["pair"].to_numpy(np.int64), got["n"].to_numpy(np.int64), got["best"].to_numpy(bool)))
    schema = pa.schema([*_FIELDS[:7], ("n_best", pa.int64()), ("count_sum", pa.int64()), *_FIELDS[7:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        keys, n, best = known.value
        for batch in batches:
            out: list[tuple] = []
            ends, pairs, times = batch.column(7).offsets.to_numpy(), batch.column(7).values.to_numpy(), batch.column(8).values.to_numpy()
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            warm = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            for a, b in zip(ends, ends[1:]):
                w, t = warm[a:b], times[a:b]
                k = at[a:b][w]
                out.append((int(t[w][best[k]].sum()), int((t[w] * n[k]).sum()), pairs[a:b][~w], t[~w]))
            added = [pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), *schema.types[-2:]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *added], schema=schema)

    return made.mapInArrow(run, f"{_DDL.split(', pairs')[0]}, n_best long, count_sum long, pairs array<long>, times array<long>")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): for each row of docs (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), and for each
    pair of ids that some document links (a, b, n documents, best). n_best counts links whose pair is the most frequent of
    its A id (ties included), count_sum adds the counts of all links; groups is a SHA-256 of the groups' ids.

    Null and empty texts, and those whose tokens' bytes aren't a space and the text, have no tokens: zeros and ''. Special
    strings in texts are plain text. Each row is a document, equal rows too; null ids stay; very long texts are aligned
    whole; no rows give none; other columns, whatever their names, play no part.
    """
    rows = texts(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    made = stored(_documents(rows, tokenizers or default_tokenizers()), "aligned")
    a = F.shiftright("pair", 32)
    counts = made.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(a)))
    counts = stored(counts, "aligned_pairs")
    sums = stored(_with_hot(made, counts.orderBy(F.desc("n"), "pair").limit(HOT)), "aligned_sums")
    forget(made)
    rest = sums.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    cold = rest.join(counts, "pair").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = sums.join(cold, "uid", "left").select("id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups")
    return whole, counts.select(a.alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n", "best")
