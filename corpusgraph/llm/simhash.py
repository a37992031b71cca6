"""Operator 5: near-duplicate documents by SimHash, linked with pigeonring filtering.

A 64-bit fingerprint is a ring of `segments` segments. If two fingerprints differ in at most `bits` places, some start
exists from which every chain of consecutive segments holds at most its proportional share of the budget
(Qin and Xiao, 2018): l segments differ in at most l * bits / segments places. The first two segments of such a chain
make the join key (the first equal, the second with at most its share flipped on the probing side), the longer chains
and then the whole distance are checked inside the join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import begin, forget, stored, texts
from .components import components

LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles in order, repeats included, in pieces that bound the memory of a long text; a
    text of fewer words is one shingle, one without words none."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return
    joined, sizes = b" ".join(w), np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    k = min(words, len(w))
    digest, n = xxhash.xxh64_intdigest, len(w) - k + 1
    for at in range(0, n, 65536):
        spans = zip(starts[at : min(at + 65536, n)].tolist(), ends[at + k - 1 : at + 65536 + k - 1].tolist())
        yield np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")


def fingerprint_of(hashes: Iterable[np.ndarray]) -> int:
    """The SimHash of shingles, as a signed 64-bit number: a bit is 1 if set in over half of them; 0 without any."""
    votes, n = np.zeros(64, np.int64), 0
    for h in hashes:
        votes += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str, words: int = 4) -> int:
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) of every row."""

    @F.pandas_udf("long")
    def udf(text: pd.Series) -> pd.Series:
        begin()
        return pd.Series([fingerprint(x, words) for x in text], dtype="int64")

    return texts(docs, id_col, text_col).select("id", udf("text").alias("fp"))


def _ring(bits: int, segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(ring: list[tuple[int, int]], start: int, length: int) -> int:
    out = 0
    for j in range(length):
        at, width = ring[(start + j) % len(ring)]
        out |= ((1 << width) - 1) << at
    return out - (1 << 64) if out >> 63 else out


def _key(ring: list[tuple[int, int]], i: int, flips: tuple[int, ...] = ()) -> Column:
    """Segment i of fp and the one after it, the latter with some bits flipped, as one number with i."""
    fp = F.col("fp")
    (at, width), (at2, width2) = ring[i], ring[(i + 1) % len(ring)]
    part = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
    part2 = F.shiftrightunsigned(fp, at2).bitwiseAND(F.lit((1 << width2) - 1)).bitwiseXOR(F.lit(sum(1 << b for b in flips)))
    return F.shiftleft(F.shiftleft(part, 20).bitwiseOR(part2), 6).bitwiseOR(F.lit(i)).cast("long")


def _index(fps: DataFrame, ring: list[tuple[int, int]], *more: str) -> DataFrame:
    return fps.select(F.col("fp").alias("v"), *more, F.explode(F.array(*[_key(ring, i) for i in range(len(ring))])).alias("index_key"))


def links(fps: DataFrame, bits: int = 4, segments: int | None = None, apart_by: str | None = None) -> DataFrame:
    """fps(fp), distinct -> pairs (u, v), u < v, at `bits` or fewer differing bits: all of them, each once; with apart_by
    those alone whose values of that column differ."""
    segments = segments or bits + 1
    ring, share = _ring(bits, segments), [length * bits // segments for length in range(segments + 1)]
    if share[1]:
        raise ValueError("more segments than differing bits are needed")
    fp = F.col("fp")
    flips = {i: [c for n in range(share[2] + 1) for c in combinations(range(ring[(i + 1) % segments][1]), n)] for i in range(segments)}
    more = [F.col(apart_by)] if apart_by else []
    index = _index(fps, ring, *[m.alias("v_of") for m in more])
    probe = fps.select(fp.alias("u"), *[m.alias("u_of") for m in more], F.explode(F.array(*[_key(ring, i, c) for i in range(segments) for c in flips[i]])).alias("key"))
    apart = F.col("u").bitwiseXOR(F.col("v"))

    def chained(i: int) -> Column:
        """Every chain from segment i keeps to its share."""
        out = F.lit(True)
        for length in range(1, segments):
            out = out & (F.bit_count(apart.bitwiseAND(F.lit(_mask(ring, i, length)))) <= share[length])
        return out

    start, found = F.col("key").bitwiseAND(F.lit(63)), F.lit(False)
    for i in reversed(range(segments)):  # the first start with kept chains counts, so that a pair comes once
        found = F.when(chained(i), start == i).otherwise(found)
    met = (F.col("key") == F.col("index_key")) & (F.col("u") < F.col("v"))
    if apart_by:
        met = met & (F.col("u_of") != F.col("v_of"))
    return probe.join(index, met & (F.bit_count(apart) <= bits) & found).select("u", "v")


def spanning_links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """fps(fp), distinct -> links (u, v) at `bits` or fewer differing bits that join whatever links() joins, but not all
    pairs of a cluster: each fingerprint first meets the least and the greatest of those that share two segments with
    it, and links() then gives what is still apart."""
    ring = _ring(bits, bits + 1)
    index = stored(_index(fps, ring), "simhash_index")
    ends = index.groupBy("index_key").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high")
    star = index.join(ends, "index_key").select("v", F.explode(F.array("low", "high")).alias("u"))
    star = star.where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits))
    star = stored(star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "simhash_star")
    forget(index)
    rooted = fps.select("fp").join(components(star), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return star.unionByName(links(stored(rooted, "simhash_rooted"), bits, apart_by="root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row (id, fp, component) for each row of docs; component is the smallest id that links of `bits` or fewer
    differing bits reach.

    Null and empty texts have fingerprint 0 and link like any other; rows with a null id keep it and take part (a null
    is never the smallest unless alone); equal rows give equal rows; no rows give none. Copies meet as one fingerprint,
    so a group of copies makes no pairs.
    """
    each = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = each.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    distinct = stored(distinct, "distinct")
    return grouped(each, distinct, stored(spanning_links(distinct.select("fp"), bits), "links"))


def grouped(each: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, fp, component) of each(id, fp), from distinct(fp, least id, n rows) and links (u, v) between its fps.

    A node is named by its least id, then its fp, so that a component's root says what it is called.
    """
    names = distinct.select("fp", F.struct(F.col("least").isNull().alias("unnamed"), "least", "fp").alias("name"))
    named = pairs.join(names.toDF("u", "un"), "u").join(names.toDF("v", "vn"), "v").select(F.col("un").alias("u"), F.col("vn").alias("v"))
    root = stored(components(named), "roots").select(F.col("node.fp").alias("fp"), F.col("root.least").alias("component"))
    copies = distinct.where("n > 1").select("fp", F.col("least").alias("component")).join(root.select("fp"), "fp", "left_anti")
    classes = stored(root.unionByName(copies), "classes")
    return each.join(classes, "fp", "left").select("id", "fp", F.coalesce("component", "id").alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """docs with one document of each group that fingerprints link left, the one with the smallest id; equal rows count
    as copies, so one of them stays. Columns and their order stay."""
    return first_of_groups(docs, near_duplicates(docs, id_col, text_col, words, bits), id_col)


def first_of_groups(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is the component that found(id, component) gives it, equal rows once."""
    drop = found.where("id <> component").select(F.col("id").alias("__drop")).distinct()
    again = found.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null").select(F.col("id").alias("__again"))
    kept = docs.join(drop, docs[id_col] == drop["__drop"], "left_anti")
    once = kept.join(again, kept[id_col] == again["__again"], "left_anti")
    return once.unionByName(kept.join(again, kept[id_col] == again["__again"], "left_semi").dropDuplicates())
