"""Operator 2: near-duplicate lines by a segment-partition edit join.

A line of l characters is cut into t + 1 segments for t allowed edits; a line within t edits holds one of them whole, at
a place that the lengths and the segment's number bound. So each line files its segments under (length, number, text)
and probes the substrings that may match (Li et al., 2011); pairs that meet are verified by banded bit-parallel edit
distance. Equal lines meet first, as one, and only lines of candidate pairs are moved as text.

A segment that many different lines file would make all pairs of a group. Its lines are compared in blocks instead: a
task takes one block of each side and gives each line's number of links and the links of a spanning forest. Each pair
counts at the first segment that its lines share, so none counts twice and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, forget, stored, texts
from .components import components
from .substrings import drop_parts, parts_of

#: Edits allowed at most, and characters for each allowed edit: shorter lines allow fewer.
EDITS, CHARS_AN_EDIT = 2, 10
#: A segment that more different lines than this file is compared in blocks of so many lines a side.
HOT, BLOCK = 8, 512
_BLANK = " \t\n\v\f\r"


def allowed(length: int) -> int:
    return min(EDITS, length // CHARS_AN_EDIT)


def segments(length: int) -> list[tuple[int, int]]:
    """(start, size) of a line's segments; the later ones are the longer."""
    n = allowed(length) + 1
    size, longer = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        s = size + (i >= n - longer)
        out.append((at, s))
        at += s
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = 1 << 18  # characters whose powers are kept; a longer line makes its own


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_STEPS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class _Hashed:
    """Lines whose substrings are hashed many at once: a polynomial's running sums give that of any substring."""

    def __init__(self, lines: list[str]):
        self.size = np.array([len(x) for x in lines], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        up, self.down = _kept_powers() if len(codes) < _STEPS else _powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=self.sums[1:])

    def keys(self, which: np.ndarray, start: np.ndarray, size: np.ndarray, length: np.ndarray, number: int) -> np.ndarray:
        """Keys of `size` characters from start in each of the lines `which`, as segment `number` of lines of a length."""
        a = self.begin[which] + start
        h = (self.sums[a + size] - self.sums[a]) * self.down[a] + (length * 8 + number).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for shift, by in ((32, 0xC2B2AE3D27D4EB4F), (29, 0x165667B19E3779F9)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def _cut(length: np.ndarray, edits: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of that segment of lines of these lengths, as segments() has them."""
    size, longer = np.divmod(length, edits + 1)
    shorter = edits + 1 - longer
    return number * size + np.maximum(0, number - shorter), size + (number >= shorter)


def _allowed(length: np.ndarray) -> np.ndarray:
    return np.minimum(EDITS, length // CHARS_AN_EDIT)


def index_entries(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, number) of each segment of the lines."""
    h, out = _Hashed(lines), []
    t = _allowed(h.size)
    for edits in range(1, EDITS + 1):
        which = np.flatnonzero(t == edits)
        for i in range(edits + 1):
            start, size = _cut(h.size[which], edits, i)
            out.append((which, h.keys(which, start, size, h.size[which], i), np.full(len(which), i)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _places(i: int, a: int, s: int, t: int, shorter: int, longer: int) -> tuple[int, int]:
    """First and last place at which segment i (s characters from a) of the shorter line can stand in the longer."""
    apart = longer - shorter
    return max(0, a - i, a + apart - (t - i)), min(longer - s, a + i, a + apart + (t - i))


def probe_entries(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, number, same): keys under which a line of the same length or shorter, within its allowed edits, may be
    filed, with the segment's number and whether the lengths are the same; each once for a line."""
    h, out = _Hashed(lines), []
    for apart in range(EDITS + 1):
        shorter = h.size - apart
        t = np.where(shorter > 0, _allowed(shorter), 0)
        for edits in range(max(1, apart), EDITS + 1):
            which = np.flatnonzero(t == edits)
            short = shorter[which]
            for i in range(edits + 1):
                a, s = _cut(short, edits, i)
                low = np.maximum(np.maximum(0, a - i), a + apart - (edits - i))
                high = np.minimum(np.minimum(h.size[which] - s, a + i), a + apart + (edits - i))
                for k in range(int((high - low).max(initial=-1)) + 1):
                    fits = low + k <= high
                    w = which[fits]
                    out.append((w, h.keys(w, low[fits] + k, s[fits], short[fits], i), np.full(len(w), i), np.full(len(w), apart == 0)))
    line, key, number, same = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((key, line))
    line, key = line[order], key[order]
    first = np.r_[True, (line[1:] != line[:-1]) | (key[1:] != key[:-1])] if len(line) else np.empty(0, bool)
    return line[first], key[first], number[order][first], same[order][first]


def first_shared(shorter: str, longer: str) -> int:
    """The number of the shorter line's first segment that probing with the longer finds, or -1."""
    t = allowed(len(shorter))
    for i, (a, s) in enumerate(segments(len(shorter))):
        low, high = _places(i, a, s, t, len(shorter), len(longer))
        if low <= high and longer.find(shorter[a : a + s], low, high + s) >= 0:
            return i
    return -1


def _alike(a: str, b: str) -> int:
    """How many characters two strings begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def edits_between(a: str, b: str, most: int) -> int:
    """The edit distance of two strings, or most + 1 if it is larger. Bit k of a row's e-th word says that diagonal
    k - most is reached with e edits or fewer."""
    if abs(len(b) - len(a)) > most:
        return most + 1
    # what both begin and end with costs no edit
    same = _alike(a, b)
    a, b = a[same:], b[same:]
    same = _alike(a[::-1], b[::-1])
    a, b = a[: len(a) - same], b[: len(b) - same]
    m, n = len(a), len(b)
    if not m or not n:
        return max(m, n)
    place: dict[str, int] = {}
    for j, c in enumerate(b):
        place[c] = place.get(c, 0) | 1 << (j + most)
    band = (1 << (2 * most + 1)) - 1
    rows = [1 << most]
    for _ in range(most):
        rows.append(rows[-1] | rows[-1] << 1)
    for i, c in enumerate(a):
        match = place.get(c, 0) >> i & band
        new = [rows[0] & match]
        for e in range(1, most + 1):
            new.append((rows[e] & match | rows[e - 1] | rows[e - 1] >> 1 | new[e - 1] << 1) & band)
        rows = new
        if not rows[-1]:
            return most + 1
    end = 1 << (n - m + most)
    return next((e for e in range(most + 1) if rows[e] & end), most + 1)


def _lines(text: str) -> list[tuple[int, str]]:
    """(number, line) of each line that isn't blank."""
    return [(k, x) for k, x in enumerate(text.split("\n")) if x.strip(_BLANK)]


def _part(row: dict) -> list[tuple[int | None, int, str]]:
    """(id, line number, line) of all lines of a part that aren't blank, in order: their places are the lines' names."""
    body, at, out = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=sum(row["sizes"])), 0, []
    for i, size in zip(row["ids"], row["sizes"]):
        out += [(i, k, x) for k, x in _lines(body[at : at + size].decode("utf-8", "surrogatepass"))]
        at += size
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _batch(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)


def distinct_lines(parts: DataFrame) -> DataFrame:
    """(h1, h2, id, line, part, at, copies): each different line with its first place and its number of places."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("line", pa.int32()), ("part", pa.int64()), ("at", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            seen: dict[bytes, list] = {}
            for at, (i, k, x) in enumerate(_part(r)):
                h = xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass"))
                got = seen.get(h)
                if got is None:
                    seen[h] = [i, k, at, 1]
                else:
                    got[3] += 1
                    if (-1 if i is None else i, k) < (-1 if got[0] is None else got[0], got[1]):
                        got[:3] = i, k, at
            h1, h2 = ([int.from_bytes(h[a : a + 8], "little", signed=True) for h in seen] for a in (0, 8))
            i, k, at, n = zip(*seen.values()) if seen else ((), (), (), ())
            yield _batch(schema, h1, h2, list(i), list(k), [r["part"]] * len(h1), list(at), list(n))

    each = parts.mapInArrow(run, "h1 long, h2 long, id long, line int, part long, at int, n long")
    first = each.groupBy("h1", "h2").agg(F.min(F.struct("id", "line", "part", "at")).alias("first"), F.sum("n").alias("copies"))
    return first.select("h1", "h2", "first.*", "copies")


def _with_names(parts: DataFrame, lines: DataFrame) -> DataFrame:
    """The parts, each with the places of those of its lines that stand for all equal ones."""
    names = lines.groupBy(F.col("part").alias("p")).agg(F.collect_list("at").alias("ats"))
    return parts.join(names, F.col("part") == F.col("p")).drop("p")


def _keys(named: DataFrame, probe: bool) -> DataFrame:
    """(key, number, same, part, at) of the lines in named; same is null on the index side."""
    schema = pa.schema([("key", pa.int64()), ("number", pa.int32()), ("same", pa.bool_()), ("part", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for r in _rows(batches):
            lines = _part(r)
            ats = [at for at in r["ats"] if len(lines[at][2]) >= CHARS_AN_EDIT]
            sizes = np.cumsum([len(lines[at][2]) for at in ats])
            cuts = np.searchsorted(sizes, np.arange(1, (sizes[-1] if len(sizes) else 0) // _STEPS + 1) * _STEPS).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(ats)]):  # lines of less than _STEPS characters at once, or a longer one
                if a == b:
                    continue
                some = [lines[at][2] for at in ats[a:b]]
                line, key, number, *same = probe_entries(some) if probe else index_entries(some)
                same = pa.array(same[0]) if probe else pa.nulls(len(line), pa.bool_())
                columns = pa.array(key), pa.array(number.astype(np.int32)), same, pa.array(np.full(len(line), r["part"])), pa.array(np.array(ats[a:b], np.int32)[line])
                yield pa.RecordBatch.from_arrays(list(columns), schema=schema)

    return named.mapInArrow(run, "key long, number int, same boolean, part long, at int")


_PLACE = [("id", pa.int64()), ("line", pa.int32()), ("part", pa.int64()), ("at", pa.int32())]
_COMPARED = pa.schema([*((f"u{k}", t) for k, t in _PLACE), *((f"v{k}", t) for k, t in _PLACE), ("links", pa.int64())])


def _compare(table: pa.Table) -> pa.Table:
    """A block of index lines against a block of probing ones, all of one segment: a row (line, itself, links) for each
    line with links, and a row (line, line, 0) for each link of a spanning forest."""
    begin()
    rows = table.select(["number", "same", "id", "line", "part", "at", "text"]).to_pylist()
    name = lambda r: (r["id"], r["line"], r["part"], r["at"])
    index = [(name(r), r["text"]) for r in rows if r["same"] is None]
    root, degree, edges = {}, {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for r in rows:
        if r["same"] is None:
            continue
        v, b, number = name(r), r["text"], r["number"]
        for u, a in index:
            if u == v or r["same"] and u[2:] > v[2:] or first_shared(a, b) != number:
                continue
            most = allowed(len(a))
            if edits_between(a, b, most) <= most:
                degree[u], degree[v] = degree.get(u, 0) + 1, degree.get(v, 0) + 1
                if find(u) != find(v):
                    root[find(u)] = find(v)
                    edges.append((*u, *v, 0))
    out = edges + [(*x, *x, n) for x, n in degree.items()]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), _COMPARED.types)], schema=_COMPARED) if out else _COMPARED.empty_table()


def links(parts: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) that connect all different lines within the edits that the shorter one allows, and each linked
    line's number of such lines (n, links). A line's name is struct(id, line, part, at), the place that stands for all
    equal ones, so that the least name of a class is its first line; until lines are compared, part and at alone."""
    names = stored(_with_names(parts, lines).select("part", "ats"), "names")
    named = parts.join(names, "part")
    index = stored(_keys(named, False).select("key", "number", "part", "at"), "line_index")
    sizes = index.groupBy("key").agg(F.count("*").alias("n"), F.min("number").alias("number"))
    hot = stored(sizes.where(F.col("n") > HOT).select(F.col("key").alias("hot_key"), "number", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "line_hot")
    # in the join a hot segment stands for its blocks, any other for each of its lines
    cold = index.join(hot.select("hot_key"), F.col("key") == F.col("hot_key"), "left_anti").select("key", F.struct("part", "at").alias("u"), F.lit(None).cast("int").alias("block"))
    slots = cold.unionByName(hot.select(F.col("hot_key").alias("key"), F.lit(None).cast(cold.schema["u"].dataType).alias("u"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    probe = _keys(named, True).select(F.col("key").alias("k"), "number", "same", F.struct("part", "at").alias("v"))
    met = probe.join(slots, F.col("key") == F.col("k")).where("u is null or (u <> v and (not same or u < v))")
    met = stored(met.select("key", "number", "same", "u", "v", "block", F.col("u").isNull().alias("hot")), "line_met", ["hot"])

    pairs = stored(met.where("not hot").groupBy("u", "v").agg(F.expr("bit_or(shiftleft(1, number))").alias("numbers")), "line_pairs")
    probing = met.where("hot")
    probes = stored(probing.where("block = 0").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("probes")).join(hot.withColumnRenamed("hot_key", "key"), "key"), "line_blocks")
    filed = index.select("key", "part", "at").join(probes, "key")
    filed = filed.select("key", "number", F.lit(None).cast("boolean").alias("same"), F.struct("part", "at").alias("w"), F.pmod(F.xxhash64("part", "at"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("other"))
    asked = probing.join(probes.select("key", "probes"), "key").select("key", "number", "same", F.col("v").alias("w"), "block", F.pmod(F.xxhash64("v"), F.col("probes")).cast("int").alias("other"))
    sides = stored(filed.unionByName(asked), "line_sides")

    wanted = pairs.select(F.col("u").alias("w")).unionByName(pairs.select(F.col("v").alias("w"))).unionByName(sides.select("w")).distinct()
    wanted = wanted.groupBy(F.col("w.part").alias("part")).agg(F.collect_list("w.at").alias("ats"))
    schema = pa.schema([*_PLACE, ("text", pa.string())])

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for r in _rows(batches):
            lines = _part(r)
            ids, numbers, texts = zip(*(lines[at] for at in r["ats"]))
            yield _batch(schema, list(ids), list(numbers), [r["part"]] * len(ids), r["ats"], list(texts))

    text = parts.join(wanted, "part").mapInArrow(said, "id long, line int, part long, at int, text string")
    text = stored(text.select(F.struct("part", "at").alias("w"), F.struct("id", "line", "part", "at").alias("name"), "text"), "line_texts")
    both = pairs.join(text.toDF("u", "un", "a"), "u").join(text.toDF("v", "vn", "b"), "v").select(F.col("un").alias("u"), F.col("vn").alias("v"), "numbers", "a", "b")

    @F.pandas_udf("boolean")
    def linked(a, b, numbers):
        import pandas as pd

        out = []
        for x, y, met_at in zip(a, b, numbers):
            most, first = allowed(len(x)), first_shared(x, y)
            out.append(first >= 0 and bool(met_at >> first & 1) and edits_between(x, y, most) <= most)
        return pd.Series(out, dtype=bool)

    single = stored(both.where(linked("a", "b", "numbers")).select("u", "v"), "line_links")
    blocks = sides.join(text, "w").select("key", "block", "other", "number", "same", "name.*", "text")
    fields = ", ".join(f"{x}id long, {x}line int, {x}part long, {x}at int" for x in "uv")
    blocks = blocks.groupBy("key", "block", "other").applyInArrow(_compare, f"{fields}, links long")
    name = lambda x: F.struct(*[F.col(f"{x}{k}").alias(k) for k, _ in _PLACE]).alias(x)
    blocks = stored(blocks.select(name("u"), name("v"), "links"), "line_block_links")
    forget(names, index, hot, met, pairs, probes, sides, text)
    one = F.lit(1).cast("long").alias("links")
    degree = single.select(F.col("u").alias("n"), one).unionByName(single.select(F.col("v").alias("n"), one)).unionByName(blocks.where("links > 0").select(F.col("u").alias("n"), "links"))
    return single.unionByName(blocks.where("links = 0").select("u", "v")), degree.groupBy("n").agg(F.sum("links").alias("links"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each different line that isn't blank: (id, line, copies, class_id, class_line, links).

    id and line are the first place of the line (smallest id, then number); class_id and class_line are that of the
    first line that links reach; links counts the different lines within its edits. Lines under CHARS_AN_EDIT
    characters have copies alone. Null and empty texts have no lines; lines of a null id come first.
    """
    parts = parts_of(texts(docs, id_col, text_col))
    found = _classes(parts)[0].select("id", "line", "copies", "class_id", "class_line", "links")
    drop_parts(parts)
    return found


def _classes(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    lines = stored(distinct_lines(parts), "lines")
    edges, degree = links(parts, lines)
    linked = components(edges).join(degree, F.col("node") == F.col("n")).select("node", "root", "links")
    rows = lines.withColumn("name", F.struct("id", "line", "part", "at")).join(linked, F.col("name") == F.col("node"), "left")
    first = F.coalesce("root", "name")
    out = rows.select("h1", "h2", "id", "line", "copies", first["id"].alias("class_id"), first["line"].alias("class_line"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return out, lines


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_lines, n_removed) of each row of docs: all lines but the first of each class are gone; blank lines
    stay where they are."""
    parts = parts_of(texts(docs, id_col, text_col))
    found, _ = _classes(parts)
    stays = found.where("id <=> class_id and line = class_line").select("h1", "h2", F.col("id").alias("i"), F.col("line").alias("l"))
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("part", pa.int64()), ("at", pa.int32()), ("id", pa.int64()), ("line", pa.int32())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            lines = _part(r)
            h = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for *_, x in lines]
            h1, h2 = ([int.from_bytes(x[a : a + 8], "little", signed=True) for x in h] for a in (0, 8))
            yield _batch(schema, h1, h2, [r["part"]] * len(h), list(range(len(h))), [i for i, *_ in lines], [k for _, k, _ in lines])

    each = parts.mapInArrow(places, "h1 long, h2 long, part long, at int, id long, line int")
    kept = each.join(stays, ["h1", "h2"]).where("id <=> i and line = l").groupBy(F.col("part").alias("p")).agg(F.collect_list("at").alias("ats"))
    out_schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            keep, at, name, out = set(r["ats"] or ()), 0, 0, []
            body = zstandard.ZstdDecompressor().decompress(r["body"], max_output_size=sum(r["sizes"]))
            for i, size in zip(r["ids"], r["sizes"]):
                left, lines = [], body[at : at + size].decode("utf-8", "surrogatepass").split("\n")
                at += size
                for x in lines:
                    if x.strip(_BLANK):
                        if name in keep:
                            left.append(x)
                        name += 1
                    else:
                        left.append(x)
                out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
            yield _batch(out_schema, *map(list, zip(*out)))

    return parts.join(kept, F.col("part") == F.col("p"), "left").mapInArrow(cut, "id long, text string, n_lines long, n_removed long")
