"""Operator 11: n-gram Jaccard join by prefix trees.

A document is its set of word shingles; two sets link at a Jaccard similarity of `percent` or more. Two such sets share l
shingles among the first n - ceil(percent n) + l of each in any order that holds for all sets (Wang et al., 2012); rare
shingles come first. l grows with n, and sets that share too few with others have no partner. The others are dealt into
blocks of a bounded size by the most shared of these, and a block is joined by a prefix tree: its sets, in order, are the
paths of a trie, which is walked once with all sets of the block at a time. Where paths run together, so do the partial
overlaps with every other set; a set leaves a subtree when what both have left can't make up the overlap that is missing.
Overlaps are exact, so no pair is verified again.

Only components are asked for, so a set of thousands of near copies makes no pairs: a block gives the links of a
spanning forest. What is too large for one block is dealt out twice; blocks are then joined with each other only where
shared shingles still have sets of different components, and by those sets that share enough with the other block. Nothing
that reaches the similarity is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, forget, stored, texts
from .components import components

LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Counters of shingles, told apart by so many bits of their hash; they decide the order and so speed alone.
COUNTER_BITS = 17
#: Sets of a block, and their shingles, about.
BLOCK, BLOCK_SHINGLES = 1_024, 1 << 17


def shingle_set(text: str, words: int = 3) -> np.ndarray:
    """The set of 64-bit hashes of the text's word shingles, sorted; a text of fewer words is one shingle, one without
    words none. A-Z are lower-cased; words stand between ASCII white space."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.empty(0, np.int64)
    k, h = min(words, len(w)), np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : len(w) - k + 1 + j]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.unique((out ^ (out >> np.uint64(30))).view(np.int64))


def set_name(shingles: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(shingles.tobytes(), 11)
    return h - (1 << 64) if h >> 63 else h


def spare(n: int, percent: int) -> int:
    """How many shingles of a set of n a partner can do without."""
    return n + -percent * n // 100


def shared_at_least(n: int, percent: int) -> int:
    """l of a set of n: one for each four shingles that it can spare, and one."""
    return 1 + (spare(n, percent) + 1) // 4


def prefix_of(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, in the order of (counter, hash), of which each partner has l at least."""
    n = len(shingles)
    if not n:
        return shingles
    return shingles[np.lexsort((shingles, counts[_counter(shingles)]))[: spare(n, percent) + shared_at_least(n, percent)]]


def asked(percent: int) -> Column:
    """l of the smallest set that a set of n can be linked with."""
    least = F.ceil(F.col("n") * percent / 100).cast("long")
    return 1 + F.floor((least - F.ceil(least * percent / 100) + 1) / 4)


def beside(placed: DataFrame, percent: int) -> DataFrame:
    """placed(key, fp, n, ...), a row for each key of a set's prefix, where the key has a set of a size that could be a
    partner's; with `after`, the row of the next larger set of the key, if that could be one. Sets of one key stand in the
    order of their sizes, so if neither neighbour could be a partner, none can. Keys are dealt out once."""
    of_key = Window.partitionBy("key").orderBy("n", "fp")
    row = F.struct(*[c for c in placed.columns if c != "key"])
    with_next = placed.withColumn("after", F.lead(row).over(of_key)).withColumn("before", F.lag("n").over(of_key))
    fits = 100 * F.col("n") >= percent * F.col("after.n")
    with_next = with_next.where(fits | (100 * F.col("before") >= percent * F.col("n")))
    return with_next.withColumn("after", F.when(fits, F.col("after"))).drop("before")


def enough(rows: DataFrame, least: Column) -> DataFrame:
    """rows(key, fp, n, ...) of sets that have as many of these keys as `least`; a set's keys are no more than its prefix."""
    of_set = F.count("*").over(Window.partitionBy("fp"))
    return rows.withColumn("keys", of_set).where(F.col("keys") >= least).drop("keys")


def _unsettled(rows: DataFrame, least: Column, gone: list[DataFrame]) -> DataFrame:
    """rows(key, fp, n, root, block) at keys that have sets of several components in several blocks, but for sets that
    have fewer such keys than a partner asks for. The table that it writes is added to gone."""
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("root", "block") for f in (F.min, F.max)]
    mixed = rows.groupBy("key").agg(*ends).where("root_min <> root_max and block_min <> block_max").select("key")
    out = stored(enough(rows.join(mixed, "key"), least), "tree_rows")
    gone.append(out)
    return out


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[list[list]]:
    begin()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield [c.to_pylist() for c in batch.slice(at, rows).columns]


def _counts(rows: DataFrame, words: int) -> np.ndarray:
    """How many sets of all documents have a shingle of each counter: 2 ** COUNTER_BITS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for (text,) in _slices(batches):
            seen = [_counter(shingle_set(x, words)) for x in text]
            total += np.bincount(np.concatenate([np.empty(0, np.int64), *seen]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["counter", "n"])

    got = rows.select("text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    out[got["counter"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _facts(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, fp, n, prefix) of every row: the name and size of its set and the set's prefix."""
    counts = rows.sparkSession.sparkContext.broadcast(_counts(rows, words))
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, text in _slices(batches):
            sets = [shingle_set(x, words) for x in text]
            columns = ids, [set_name(x) for x in sets], [len(x) for x in sets], [prefix_of(x, counts.value, percent) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)

    return rows.mapInArrow(run, "id long, fp long, n long, prefix array<long>")


def tree_links(sets: list[np.ndarray], roots: list[int], percent: int, probes: int | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets that reach the similarity and join what `roots` and earlier pairs leave apart: a spanning
    forest. With `probes`, the first so many sets are joined with the others alone, else all with each other."""
    n = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    alone = int((times == 1).sum())  # a shingle of one set is no part of any overlap: its path leaves it out
    keep = times[code] > 1
    code, owner = rank[code[keep]] - alone, owner[keep]
    at = np.lexsort((code, owner))
    code, owner, width = code[at], owner[at], max(1, len(times) - alone)
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    line = owner * width + code  # ascending: a set's shingles up to some place are found by bisection
    path = [code[a:b].astype(">u4") for a, b in zip(first, first[1:])]
    in_tree = sorted(range(probes or 0, len(sets)), key=lambda i: path[i].tobytes())  # a trie, laid out
    length, size = np.diff(first)[in_tree], n[in_tree]
    place = np.full(len(sets), -1)
    place[in_tree] = np.arange(len(in_tree))
    has = np.zeros((width, len(sets) if probes is None else probes), bool)
    has[code[owner < has.shape[1]], owner[owner < has.shape[1]]] = True

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    found, walk = [], [(0, len(in_tree), 0, np.arange(has.shape[1]), np.zeros(has.shape[1], np.int64))]
    while walk:
        lo, hi, depth, alive, overlap = walk.pop()
        p, q = path[in_tree[lo]], path[in_tree[hi - 1]]
        m = min(len(p), len(q))
        differ = np.flatnonzero(p[depth:m] != q[depth:m])
        end = depth + int(differ[0]) if len(differ) else m
        if probes is None:  # a pair is met once, at the later of its two paths
            alive, overlap = (x[place[alive] < hi] for x in (alive, overlap))
        if end > depth:
            overlap = overlap + has[np.ix_(p[depth:end].astype(np.int64), alive)].sum(0)
        left = first[alive + 1] - np.searchsorted(line, alive * width + (int(p[end - 1]) if end else -1), "right")
        most = overlap + np.minimum(left, int(length[lo:hi].max()) - end)
        fit = (100 + percent) * most >= percent * (n[alive] + int(size[lo:hi].min()))
        alive, overlap = alive[fit], overlap[fit]
        if not len(alive):
            continue
        while lo < hi and length[lo] == end:  # paths that end here
            j = in_tree[lo]
            near = (100 + percent) * overlap >= percent * (n[alive] + n[j])
            if probes is None:
                near &= place[alive] < lo
            for i in alive[near].tolist():
                a, b = find(roots[i]), find(roots[j])
                if a != b:
                    parent[a] = b
                    found.append((i, j))
            lo += 1
        while lo < hi:
            step, after = path[in_tree[lo]][end], lo + 1
            while after < hi and path[in_tree[after]][end] == step:
                after += 1
            walk.append((lo, after, end, alive, overlap))
            lo = after
    return found


def _cell_links(cells: DataFrame, percent: int, words: int) -> DataFrame:
    """(u, v) from cells(cell, probe, fp, root, text): the links of a spanning forest of each cell; probe says that a row is
    of the first of two blocks, and is null where a cell is one block. Texts move, which are smaller than their sets."""

    def links_of(fps: list[int], roots: list[int], sets: list[np.ndarray], probe: list) -> list[tuple[int, int]]:
        if len(set(roots)) < 2:
            return []
        order = sorted(range(len(fps)), key=lambda i: (not probe[i], fps[i]))
        probes = None if probe[0] is None else sum(map(bool, probe))
        if probes is not None and not 0 < probes < len(fps):
            return []
        got = tree_links([sets[i] for i in order], [roots[i] for i in order], percent, probes)
        return [(fps[order[i]], fps[order[j]]) for i, j in got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        cell, rows = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                got = links_of(list(rows), *map(list, zip(*rows.values())))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for c, probe, fp, root, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if c != cell:
                    yield from done()
                    cell, rows = c, {}
                rows[fp] = (root, shingle_set(text, words), probe)
        yield from done()

    dealt = cells.select("cell", "probe", "fp", "root", "text").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "u long, v long")


def _homes(rows: DataFrame, salt: int) -> DataFrame:
    """(fp, root, block, parts): the block of each set is that of its most shared key; what is too much for a block is dealt
    out to several by hash, another one for each salt."""
    many = rows.groupBy("key").agg(F.count("*").alias("many"), F.sum("n").alias("total"))
    home = rows.join(many, "key").groupBy("fp").agg(F.max(F.struct("many", "key", "total")).alias("home"), F.min("root").alias("root"))
    parts = F.ceil(F.greatest(F.col("home.many") / BLOCK, F.col("home.total") / BLOCK_SHINGLES)).cast("long")
    home = home.select("fp", "root", "home.key", parts.alias("parts"))
    return home.select("fp", "root", F.xxhash64("key", F.pmod(F.xxhash64("fp", F.lit(salt)), F.col("parts"))).alias("block"), "parts")


def _merged(rows: DataFrame, links: DataFrame, gone: list[DataFrame]) -> DataFrame:
    """rows with the roots of components that the links join. Tables that it writes are added to gone."""
    known = rows.select("fp", "root").distinct()
    steps = links.join(known.toDF("u", "ur"), "u").join(known.toDF("v", "vr"), "v").select(F.col("ur").alias("u"), F.col("vr").alias("v"))
    up = stored(components(steps), "tree_roots")
    gone.append(up)
    return rows.join(up, rows["root"] == up["node"], "left").select(*[c for c in rows.columns if c != "root"], F.coalesce(up["root"], rows["root"]).alias("root"))


def still_apart(shared: DataFrame, picked: DataFrame, percent: int, words: int) -> DataFrame:
    """Links (u, v) that, with those behind `root`, join all sets that reach the similarity.

    shared(key, fp, n, root): sets at each shingle of their prefixes that several have, with the component that they are
    known to be in (fp at first). picked(fp, text): a text of each of these sets. Both are tables.
    """
    alone, least = F.lit(None).cast("boolean").alias("probe"), asked(percent)
    home = stored(_homes(shared, 0), "tree_home")
    links = stored(_cell_links(home.select("fp", "root", F.col("block").alias("cell"), alone).join(picked, "fp"), percent, words), "tree_links")
    gone = [home, links]
    rows = _unsettled(_merged(shared.join(home.select("fp", "block"), "fp"), links, gone), least, gone)
    # large blocks are dealt anew, so that what lies across them comes together in few links
    again = _homes(rows, 1).where("parts > 1").select("fp", "root", F.col("block").alias("cell"), alone)
    more = stored(_cell_links(again.join(picked, "fp"), percent, words), "tree_links")
    gone.append(more)
    rows = _unsettled(_merged(rows, more, gone), least, gone)
    # a set meets another block if it shares as many keys with it as a partner there would ask for
    # and if a set of the key there has a size that could be a partner's
    of_key = rows.groupBy("key", F.col("block").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    sizes = (100 * F.col("high") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("low"))
    met = rows.join(of_key, (rows["key"] == of_key["key"]) & (rows["block"] != of_key["other"]) & sizes).groupBy("fp", "block", "other").agg(F.count("*").alias("keys"), F.first("n").alias("n"), F.first("root").alias("root"))
    met = met.where(F.col("keys") >= least)
    across = met.select("fp", "root", F.xxhash64(F.least("block", "other"), F.greatest("block", "other")).alias("cell"), (F.col("block") < F.col("other")).alias("probe"))
    rest = _cell_links(across.join(picked, "fp"), percent, words)
    links = stored(links.unionByName(more).unionByName(rest), "tree_all_links")
    forget(*gone)
    return links


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """One row (id, n_shingles, component) for each row of docs; component is the smallest id that links of a Jaccard
    similarity of `percent` or more reach, its own included.

    A null, empty or blank text has the empty set and is linked with nothing; a text of fewer words than a shingle's is one
    shingle. Equal rows give equal rows; rows of equal sets are links. A null id keeps it and takes part, and is never the
    smallest unless alone. No rows give none; very long texts are read whole; other columns, whatever their names, play no
    part.
    """
    rows = texts(docs, id_col, text_col)
    facts = stored(_facts(rows, words, percent), "tree_facts")
    distinct = stored(facts.where("n > 0").groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "tree_distinct")
    each = stored(facts.select("id", "fp", "n"), "tree_each")
    forget(facts)
    placed = distinct.select("fp", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("key"))
    shared = enough(beside(placed, percent).select("key", "fp", "n"), asked(percent))
    shared = stored(shared, "tree_shared")
    wanted = shared.select("fp").distinct()
    some = stored(each.select("id", "fp").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("some")).select("some").distinct(), "tree_some")

    def name_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (text,) in _slices(batches, 100):
            yield pa.RecordBatch.from_arrays([pa.array([set_name(shingle_set(x, words)) for x in text], pa.int64()), pa.array(text, pa.string())], ["fp", "text"])

    # rows of one id may differ, so texts go by their sets' names; one that comes twice in a block counts once there
    picked = stored(rows.join(some, F.col("id").eqNullSafe(F.col("some")), "left_semi").select("text").mapInArrow(name_of, "fp long, text string"), "tree_texts")
    links = still_apart(shared.withColumn("root", F.col("fp")), picked, percent, words)
    forget(shared, some, picked)
    name = F.struct(F.col("least").isNull().alias("unnamed"), "least", "fp").alias("name")  # so that a root is its component's least id
    names = distinct.select("fp", name)
    named = links.join(names.toDF("u", "un"), "u").join(names.toDF("v", "vn"), "v").select(F.col("un").alias("u"), F.col("vn").alias("v"))
    root = components(named).select(F.col("node.fp").alias("fp"), F.col("root.least").alias("component"))
    copies = distinct.where("copies > 1").select("fp", F.col("least").alias("component")).join(root.select("fp"), "fp", "left_anti")
    known = stored(root.unionByName(copies), "tree_classes")
    return each.join(known, "fp", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component"))
