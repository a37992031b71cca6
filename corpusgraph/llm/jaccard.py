"""Operator 5 where similarity is asked for in words: near-duplicate documents by the Jaccard similarity of their word
shingles.

Candidates are documents whose SimHash fingerprints the pigeonring filter links, verified on the whole sets of shingles.
Fingerprints within a few bits don't find all pairs at 0.8, so those still apart are completed exactly by prefix
filtering: two sets that reach the similarity share some shingles among the first few of each in any order that holds for
all sets (Chaudhuri et al., 2006; Wang et al., 2012), and the places there bound what a pair can share (Xiao et al., 2008). What is frequent in
a sample comes last in the order: that keeps common passages out of the prefixes and decides about speed alone. Nothing
that reaches the similarity is lost.

Groups need no pairs within: a document first meets one other of its SimHash cluster and the next larger and smaller of
each shingle. Those still apart then meet in blocks of the prefix-tree join, which gives the links of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, forget, stored, texts
from .components import components
from .prefix_tree import asked, beside, enough, shared_at_least, spare, still_apart
from .simhash import fingerprint_of, first_of_groups, grouped, shingle_hashes, spanning_links

#: One document in so many is looked at for frequent shingles; those in SEEN of them or more come last, MOST at most.
SAMPLE, SEEN, MOST = 8, 3, 100_000


def shingles(text: str, words: int = 5) -> np.ndarray:
    """The set of hashes of the text's word shingles, sorted; a shorter text is one shingle."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, words)])).view(np.int64)


def parities(shingle_set: np.ndarray) -> np.ndarray:
    """1,024 bits, each the parity of the shingles that hash to it, as 16 numbers. Two sets differ in at least as many
    shingles as their parities in bits, so bits that differ too often rule a pair out for certain."""
    count = np.bincount((shingle_set.view(np.uint64) >> np.uint64(20)).astype(np.int64) & 1023, minlength=1024)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view("<i8")


def name(shingle_set: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(shingle_set.tobytes(), 7)
    return h - (1 << 64) if h >> 63 else h


def prefix(shingle_set: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in the order of (times seen, hash), of which each partner has shared_at_least()."""
    n = len(shingle_set)
    if not n:
        return shingle_set
    count = np.zeros(n, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, shingle_set), len(often) - 1)
        count = np.where(often[at] == shingle_set, times[at], 0)
    return shingle_set[np.lexsort((shingle_set, count))[: spare(n, 80) + shared_at_least(n, 80)]]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[list[list]]:
    begin()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield [c.to_pylist() for c in batch.slice(at, rows).columns]


def _frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of the sample have, sorted, and how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (text,) in _slices(batches, 100):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(x, words) for x in text]), pa.int64())], ["key"])

    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    got = counts.orderBy(F.desc("n"), "key").limit(MOST).toPandas().sort_values("key")
    return got["key"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def _each(rows: DataFrame, words: int) -> DataFrame:
    """(id, fp, n, sim, bits, prefix) of every row: the name, size, SimHash and parities of its set of shingles and the set's
    prefix."""
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, words))
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("sim", pa.int64()), ("bits", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = frequent.value
        for ids, text in _slices(batches):
            sets = [shingles(x, words) for x in text]
            columns = ids, [name(x) for x in sets], [len(x) for x in sets], [fingerprint_of([x.view("<u8")]) for x in sets], [parities(x) for x in sets], [prefix(x, often, times) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)

    return rows.mapInArrow(run, "id long, fp long, n long, sim long, bits array<long>, prefix array<long>")


def _verified(pairs: DataFrame, each: DataFrame, distinct: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """The pairs (u, v) whose sets have 0.8 of their union in common: 9 times what they share is 4 times both sizes, so 9
    times what they don't share is both sizes at most. Parities rule most others out before any set is moved."""
    bits = distinct.select("fp", "bits", "size")
    both = pairs.select("u", "v").distinct().join(bits.toDF("u", "ub", "un"), "u").join(bits.toDF("v", "vb", "vn"), "v")
    apart = F.aggregate(F.zip_with("ub", "vb", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    pairs = stored(both.where(9 * apart <= F.col("un") + F.col("vn")).select("u", "v"), "jaccard_pairs")
    wanted = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    # written first, so that its size is known and decides how the texts are joined
    some = stored(each.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("some")).select("some").distinct(), "jaccard_some")
    schema = pa.schema([("fp", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (text,) in _slices(batches, 100):
            sets = [shingles(x, words) for x in text]
            yield pa.RecordBatch.from_arrays([pa.array([name(x) for x in sets], pa.int64()), pa.array(sets, schema.types[1])], schema=schema)

    # rows of one id may differ, so the sets go by their own names
    sets = rows.join(some, F.col("id").eqNullSafe(F.col("some")), "left_semi").select("text").mapInArrow(run, "fp long, shingles array<long>")
    sets = stored(sets.join(wanted, "fp", "left_semi"), "jaccard_sets")  # a set that comes twice gives a link twice
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    links = stored(both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v"), "jaccard_links")
    forget(pairs, some, sets)
    return links


def _near(distinct: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets: each set with one of its SimHash cluster, be it linked by the ring or of equal SimHash."""
    sims = stored(distinct.groupBy(F.col("sim").alias("fp")).agg(F.min(F.col("fp")).alias("set")), "jaccard_sims")
    root = components(spanning_links(sims.select("fp")))
    across = root.where("node <> root").join(sims.toDF("node", "u"), "node").join(sims.toDF("root", "v"), "root").select("u", "v")
    equal = distinct.select(F.col("fp").alias("u"), "sim").join(sims.toDF("sim", "v"), "sim").where("u <> v").select("u", "v")
    both = across.unionByName(equal)
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row (id, fp, component) for each row of docs; component is the smallest id that links of similarity 0.8 or
    more reach, fp the name of the row's set of shingles.

    Null and empty texts have the empty set and are copies of each other; equal rows give equal rows; no rows give none.
    """
    rows = texts(docs, id_col, text_col)
    each = stored(_each(rows, words), "jaccard_each")
    distinct = stored(each.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("n").alias("size"), F.first("sim").alias("sim"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")), "jaccard_distinct")
    placed = distinct.select("fp", F.col("size").cast("int").alias("n"), F.posexplode("prefix").alias("place", "key"))
    shared = stored(beside(placed, 80), "jaccard_shared")

    left = F.least(F.col("n") - F.col("place"), F.col("after.n") - F.col("after.place"))
    reach = 9 * left >= 4 * (F.col("n") + F.col("after.n"))  # with what stands behind these places
    hubs = shared.where(reach).select(F.least("fp", "after.fp").alias("u"), F.greatest("fp", "after.fp").alias("v"))
    links = _verified(hubs.unionByName(_near(distinct)), each, distinct, rows, words)
    root = components(links)

    apart = shared.select("key", "fp", "n").join(root, F.col("fp") == F.col("node"), "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root"))
    mixed = apart.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    # partners share several of these keys, so a set with fewer has none
    apart = stored(enough(apart.join(mixed, "key"), asked(80)), "jaccard_apart")
    forget(shared)
    # sets that are still apart meet in blocks, whose links are a spanning forest, so that no group makes all its pairs
    wanted = apart.select("fp").distinct()
    some = stored(each.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("some")).select("some").distinct(), "jaccard_some")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (text,) in _slices(batches, 100):
            yield pa.RecordBatch.from_arrays([pa.array([name(shingles(x, words)) for x in text], pa.int64()), pa.array(text, pa.string())], ["fp", "text"])

    picked = rows.join(some, F.col("id").eqNullSafe(F.col("some")), "left_semi").select("text").mapInArrow(named, "fp long, text string")
    picked = stored(picked, "jaccard_texts")
    across = still_apart(apart, picked, 80, words)
    links = links.unionByName(across)
    forget(apart, some, picked)
    return grouped(each.select("id", "fp"), distinct.select("fp", "least", "n"), links)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """docs with one document of each group that links of similarity 0.8 or more join, the one with the smallest id;
    equal rows count as copies, so one of them stays. Columns and their order stay."""
    return first_of_groups(docs, near_duplicates(docs, id_col, text_col, words), id_col)
