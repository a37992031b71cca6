"""Operator 6: exact substring dedup.

Every byte goes that lies in a string of `length` bytes which also starts in a document with a smaller id. No text is
shuffled and no group of copies is gathered whole:

1. The documents are packed into parts, a table bucketed by part, which all later steps join without an exchange.
2. Anchors are places whose gram of GRAM bytes has the least hash of some window of `length` bytes, so two equal
   windows have the same anchor at the same place. Each part tells once for each gram how often it has it; grams of
   more than one document go back to their parts.
3. An anchor's context is all bytes that a window around it may cover. Each part tells each context's smallest document
   once; a context that a smaller document also has is repeated throughout.
   Strings are told apart by 128 bits of hash.
4. What is left are the ends of repeated passages. Their contexts meet by gram, and a Burrows-Wheeler transform of them
   is extended backwards, all intervals at once and by one byte each time, up to `length`; intervals in which one
   document alone is left are dropped. Windows of grams that very many places share go by their hash as in 3 instead, so
   that no gram's group is gathered.
5. Each part gets its removed stretches back.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin as new_task
from .common import forget, shared_dir, stored, texts

LENGTH, GRAM = 50, 24
#: Bytes of text in a part, about; a longer document is a part of its own.
PART = 4 << 20
#: Bytes of text for each bucket in which what parts tell meets.
BUCKET = 16 << 20
#: A gram that so many places share goes by the hashes of its windows.
COMMON = 600
#: Bytes of a long document that are hashed at once.
PIECE = 2 << 20
_A, _B, _C, _D = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x165667B19E3779F9)


def _words(raw: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places as one number; raw has 7 bytes more at least."""
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        m = (n - o + 7) // 8
        out[o::8] = np.frombuffer(raw[o : o + 8 * m].tobytes(), "<u8")
    return out


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ (x * _A)) * _B
    return h ^ (h >> np.uint64(31))


def _slide(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """The least (or greatest) of each n neighbours."""
    f, w = np.minimum if least else np.maximum, 1
    want = len(x) - n + 1
    while 2 * w <= n:
        x = f(x[:-w], x[w:])
        w *= 2
    return f(x[:want], x[n - w : n - w + want]) if n > w else x


class Texts:
    """The documents of a part in one buffer, with `length` zeros around each, so that a context is a plain slice."""

    def __init__(self, docs: list[bytes], length: int):
        self.length, pad = length, b"\0" * length
        self.sizes = np.array([len(x) for x in docs], np.int64)
        self.starts = np.cumsum(np.append(length, self.sizes[:-1] + length)) if len(docs) else np.empty(0, np.int64)
        self.buffer = np.frombuffer(pad + pad.join(docs) + pad + pad, np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, place in the buffer, hash of the gram) of each anchor, in order of place."""
        n, window = len(self.buffer) - self.length - 8, self.length - GRAM + 1
        places, hashes = [], []
        for at in range(0, max(n, 0), PIECE):  # windows that begin in the piece
            lo, hi = max(0, at - self.length), min(n, at + PIECE + self.length)
            w = _words(self.buffer[lo : hi + 40], hi - lo + 16)
            m = hi - lo
            h = _mix(_mix(_mix(np.full(m, _C), w[:m]), w[8 : 8 + m]), w[16 : 16 + m])
            key = (h >> np.uint64(34)).astype(np.uint32)
            if m < window:
                continue
            least = _slide(key, window, True)
            # a window counts if it lies in one document
            begin = lo + np.arange(len(least))
            doc = np.searchsorted(self.starts, begin, "right") - 1
            inside = (doc >= 0) & (begin + self.length <= (self.starts + self.sizes)[doc])
            padded = np.zeros(len(least) + 2 * (window - 1), np.uint32)
            padded[window - 1 : window - 1 + len(least)] = np.where(inside, least + 1, 0)
            chosen = np.flatnonzero(_slide(padded, window, False)[:m] == key + 1)
            chosen = chosen[(chosen + lo >= at) & (chosen + lo < at + PIECE)]
            places.append(chosen + lo)
            hashes.append(h[chosen])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        place = np.concatenate(places)
        return np.searchsorted(self.starts, place, "right") - 1, place, np.concatenate(hashes)

    def hashed(self, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the `size` bytes from each place: together 128 bits, so that among 10^13 strings
        no two different ones are expected to be taken for one."""
        h, g = np.full(len(begin), _A), np.full(len(begin), _C)
        at = [*range(0, size - 7, 8)] + ([size - 8] if size % 8 else [])
        eight = np.ndarray((len(self.buffer) - 7,), "<u8", self.buffer.data, 0, (1,))  # the 8 bytes from each place, as a view
        for o in at:
            word = eight[begin + o]
            h = _mix(h, word)
            g = (g ^ (word * _D)) * _A
            g ^= g >> np.uint64(29)
        return _mix(h, h >> np.uint64(17)), (g ^ (g >> np.uint64(32))) * _B


def _pack_texts(rows: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(rows))


def parts_of(docs: DataFrame, part_bytes: int = PART) -> DataFrame:
    """docs(id, text) packed into a table of parts, bucketed by part: (part, ids, sizes, body), bodies compressed."""
    schema = pa.schema([("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k, ids, rows, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                rows.append(x.as_py().encode("utf-8", "surrogatepass"))
                size += len(rows[-1])
                if size >= part_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((first + k, ids, [len(r) for r in rows], _pack_texts(rows)), schema.types)], schema=schema)
                    k, ids, rows, size = k + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((first + k, ids, [len(r) for r in rows], _pack_texts(rows)), schema.types)], schema=schema)

    spark = docs.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"parts_{uuid.uuid4().hex}"
    made = docs.mapInArrow(run, "part long, ids array<long>, sizes array<long>, body binary")
    made.write.bucketBy(buckets, "part").option("path", f"{shared_dir(spark)}/corpusgraph/{name}").option("compression", "none").saveAsTable(name)
    out = spark.table(name)
    out._parts_table = name
    return out


def drop_parts(parts: DataFrame) -> None:
    """Deletes what parts_of() wrote, once nothing that is still to be computed reads it."""
    spark, name = parts.sparkSession, parts._parts_table
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/corpusgraph/{name}")
    spark.sql(f"DROP TABLE {name}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _texts(row: dict) -> tuple[Texts, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=sum(row["sizes"]))
    ends = np.cumsum(row["sizes"]).tolist()
    ids = np.array([-(1 << 63) if i is None else i for i in row["ids"]], np.int64)  # a null id is the smallest
    return Texts([body[e - s : e] for s, e in zip(row["sizes"], ends)], LENGTH), ids


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _dealt(bucket: np.ndarray, part: int, columns: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row of blobs for each bucket: (bucket, part, blobs)."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    columns = [c[order] for c in columns]
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((int(bucket[order[a]]), part, *[c[a:b].tobytes() for c in columns]), schema.types)], schema=schema)


_BLOBS = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_CHECKED = pa.schema([*_BLOBS, ("c", pa.binary())])


def _gather(table: pa.Table, *kinds) -> list[np.ndarray]:
    """[part, a, b, ...] of all items in a bucket's blobs."""
    columns = [[np.frombuffer(x, k) for x in table.column(n).to_pylist()] for n, k in zip("abc", kinds)]
    parts = np.repeat(np.array(table.column("part").to_pylist(), np.int64), [len(x) for x in columns[0]])
    return [parts, *map(np.concatenate, columns)]


def _reply(parts: np.ndarray, *columns: np.ndarray) -> pa.Table:
    order = np.lexsort((columns[0], parts))
    parts, columns = parts[order], [x[order] for x in columns]
    cut = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else np.empty(0, np.int64)
    ends = [*cut[1:].tolist(), len(parts)]
    made = [pa.array([x[i:j].tobytes() for i, j in zip(cut.tolist(), ends)], pa.binary()) for x in columns]
    return pa.table([pa.array(parts[cut], pa.int64()), *made], schema=pa.schema([("part", pa.int64()), *((n, pa.binary()) for n, _ in zip("abc", columns))]))


def _counted(table: pa.Table) -> pa.Table:
    """Keys that more than one place has, with their number of places, to each part that has them."""
    parts, keys, n = _gather(table, "<u8", "<u2")
    uniq, inv = np.unique(keys, return_inverse=True)
    total = np.bincount(inv, n, len(uniq)).astype("<u4")[inv]
    keep = total > 1
    return _reply(parts[keep], keys[keep], total[keep])


def _firsts(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where another key or check begins, in sorted ones."""
    return np.r_[True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])] if len(keys) else np.empty(0, bool)


def _least(table: pa.Table) -> pa.Table:
    """The smallest document of each string, by key and check, to each part in which the smallest is larger."""
    parts, keys, doc, checks = _gather(table, "<u8", "<i8", "<u8")
    order = np.lexsort((doc, checks, keys))
    first = _firsts(keys[order], checks[order])
    least = np.empty(len(keys), np.int64)
    least[order] = doc[order][first][np.cumsum(first) - 1]
    keep = least < doc
    return _reply(parts[keep], keys[keep], least[keep], checks[keep])


def _meet(dealt: DataFrame, how, what: str, columns: str = "ab") -> DataFrame:
    """The blobs of each bucket together, and the replies as one row for each part."""
    replies = dealt.groupBy("bucket").applyInArrow(how, "part long, " + ", ".join(f"{c} binary" for c in columns))
    return stored(replies.groupBy("part").agg(F.collect_list(F.struct(*columns)).alias("got")), what)


def _lookup(got: list[dict] | None, kind) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their values from a part's replies."""
    a = np.concatenate([np.frombuffer(x["a"], "<u8") for x in got or ()] or [np.empty(0, np.uint64)])
    b = np.concatenate([np.frombuffer(x["b"], kind) for x in got or ()] or [np.empty(0, kind)])
    order = np.argsort(a)
    return a[order], b[order]


def _found(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray], other) -> np.ndarray:
    """The value of each key, or `other`."""
    a, b = table
    if not len(a):
        return np.full(len(keys), other)
    at = np.minimum(np.searchsorted(a, keys), len(a) - 1)
    return np.where(a[at] == keys, b[at], other)


def _joined(got: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, checks, documents) from a part's replies, in order."""
    a, b, c = (np.concatenate([np.frombuffer(x[n], k) for x in got or ()] or [np.empty(0, k)]) for n, k in (("a", "<u8"), ("b", "<i8"), ("c", "<u8")))
    order = np.lexsort((c, a))
    return a[order], c[order], b[order]


def _known(keys: np.ndarray, checks: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The document that the table has for each key and check, or the largest number."""
    a, c, b = table
    out, at, open_ = np.full(len(keys), np.iinfo(np.int64).max), np.searchsorted(a, keys), np.arange(len(keys))
    while len(open_):
        open_ = open_[at[open_] < len(a)]
        open_ = open_[a[at[open_]] == keys[open_]]
        hit = c[at[open_]] == checks[open_]
        out[open_[hit]] = b[at[open_[hit]]]
        open_ = open_[~hit]
        at[open_] += 1
    return out


def _smallest(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, checks, documents): each string once with its smallest document."""
    order = np.lexsort((docs, checks, keys))
    keys, checks, docs = keys[order], checks[order], docs[order]
    first = _firsts(keys, checks)
    return keys[first], checks[first], docs[first]


def _contexts(t: Texts, place: np.ndarray) -> np.ndarray:
    """Where each anchor's context begins; it has 2 * LENGTH - GRAM bytes, zeros where the document has none."""
    return place - (LENGTH - GRAM)


def expand(rows: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, length: int = LENGTH, seed: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(row, begin) of each window of `length` bytes, within low to high of its row, that a row of a smaller document
    also has somewhere.

    rows: texts of equal width, one after the other with a zero between as the text of a suffix array to depth `seed`,
    by prefix doubling from 8. Its intervals of equal first `seed` bytes are extended backwards: the byte before each
    suffix (the Burrows-Wheeler transform) splits an interval, and a stable sort by that byte is the order of the longer
    prefixes. Intervals of one document are dropped.
    """
    m, width = rows.shape
    flat = np.zeros((m, width + 1), np.uint8)
    flat[:, :width] = rows
    flat = np.append(flat.ravel(), np.zeros(64, np.uint8))
    n = m * (width + 1)
    rank = _words(flat, n).byteswap()
    depth = 8
    order = np.argsort(rank)
    while True:
        ranked = rank[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[np.uint64(1), (ranked[1:] != ranked[:-1]).astype(np.uint64)])
        if depth >= seed:
            break
        later = np.zeros(n, np.uint64)
        later[: n - depth] = rank[depth:]
        rank = rank * np.uint64(n + 1) + later
        order = np.argsort(rank)
        depth *= 2
    row_of, begin_of = np.divmod(order, width + 1)
    # suffixes that begin `length - depth` or more bytes into their row, and end in it
    live = (begin_of >= low[row_of] + length - depth) & (begin_of + depth <= high[row_of])
    at = order[live]
    group = rank[at].astype(np.int64)
    while True:
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
        if not len(first):
            break
        docs = doc[at // (width + 1)]
        least, most = np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
        sizes = np.diff(np.append(first, len(group)))
        if depth == length:
            out = at[docs > np.repeat(least, sizes)]
            return np.divmod(out, width + 1)
        keep = np.repeat(least < most, sizes)
        at, group = at[keep] - 1, group[keep]
        before = flat[at]
        order = np.argsort(before, kind="stable")
        at, group, before = at[order], group[order], before[order]
        group = np.cumsum(np.r_[0, (group[1:] != group[:-1]) | (before[1:] != before[:-1])]) if len(group) else group
        depth += 1
    return np.empty(0, np.int64), np.empty(0, np.int64)


_KINDS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary())])
_SPANS = pa.schema([("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches as (document << 40 | begin) and end, those that touch as one."""
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = doc << 40 | begin
    order = np.argsort(key)
    key, reach = key[order], np.maximum.accumulate((doc << 40 | end)[order])
    first = np.r_[True, key[1:] > reach[:-1]]
    last = np.r_[first[1:], True]
    return key[first], (reach[last] & ((1 << 40) - 1))


def _spans_of_contexts(table: pa.Table) -> pa.Table:
    """Contexts that met by gram -> stretches for their parts. a: gram, document, place in it (8 bytes each); b: the
    bytes; c: how many of them before and after are not the document's; d: the document's row in its part."""
    width = 2 * LENGTH - GRAM
    head = [np.frombuffer(x, "<i8").reshape(-1, 3) for x in table.column("a").to_pylist()]
    parts = np.repeat(np.array(table.column("part").to_pylist(), np.int64), [len(x) for x in head])
    head = np.concatenate(head)
    body = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, width) for x in table.column("b").to_pylist()])
    edge = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 2) for x in table.column("c").to_pylist()])
    row = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("d").to_pylist()])
    # a gram that one document alone has left says nothing
    order = np.lexsort((head[:, 1], head[:, 0]))
    g, d = head[order, 0], head[order, 1]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.append(first, len(g)))
    keep = np.zeros(len(g), bool)
    keep[order] = np.repeat(np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first), sizes)
    at = np.flatnonzero(keep)
    if not len(at):
        return _SPANS.empty_table()
    i, begin = expand(body[at], edge[at, 0].astype(np.int64), width - edge[at, 1].astype(np.int64), head[at, 1])
    i = at[i]
    begin = head[i, 2] - (LENGTH - GRAM) + begin
    return _span_rows(parts[i], row[i], begin, begin + LENGTH)


def _span_rows(parts: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    out = []
    for p in np.unique(parts):
        mine = parts == p
        key, reach = _merged(row[mine], begin[mine], end[mine])
        out.append((int(p), key.tobytes(), reach.tobytes()))
    return pa.table([pa.array(list(x), t) for x, t in zip(zip(*out), _SPANS.types)], schema=_SPANS) if out else _SPANS.empty_table()


def _spans(parts: DataFrame, buckets: int) -> DataFrame:
    """(part, got): the removed stretches of each part."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_task()
        for r in _rows(batches):
            _, _, gram = _texts(r)[0].anchors()
            keys, n = np.unique(gram, return_counts=True)
            yield from _dealt((keys % np.uint64(buckets)).astype(np.int64), r["part"], [keys, np.minimum(n, 65535).astype("<u2")], _BLOBS)

    known = _meet(parts.mapInArrow(grams, "bucket int, part long, a binary, b binary"), _counted, "grams")

    def matched(r: dict, got: list[dict]):
        t, ids = _texts(r)
        doc, place, gram = t.anchors()
        times = _found(gram, _lookup(got, "<u4"), 0)
        keep = times > 1
        doc, place, gram, times = doc[keep], place[keep], gram[keep], times[keep]
        return t, ids, doc, place, gram, times, *t.hashed(_contexts(t, place), 2 * LENGTH - GRAM)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            _, ids, doc, _, _, _, context, check = matched(r, r["got"])
            keys, checks, least = _smallest(context, check, ids[doc])
            yield from _dealt((keys % np.uint64(buckets)).astype(np.int64), r["part"], [keys, least, checks], _CHECKED)

    shown = parts.join(known, "part")
    least = _meet(shown.mapInArrow(contexts, "bucket int, part long, a binary, b binary, c binary"), _least, "contexts", "abc")

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            t, ids, doc, place, gram, times, context, check = matched(r, r["got"])
            mine = ids[doc]
            best = np.minimum(_known(context, check, _smallest(context, check, mine)), _known(context, check, _joined(r["least"])))
            begin, here = _contexts(t, place), t.starts[doc]
            before = np.maximum(here - begin, 0)
            after = np.maximum(begin + 2 * LENGTH - GRAM - here - t.sizes[doc], 0)
            sure = best < mine
            span = _merged(doc[sure], (begin - here + before)[sure], (begin - here + 2 * LENGTH - GRAM - after)[sure])
            yield _kind(0, 0, r["part"], span[0], span[1])
            open_, common = ~sure & (times < COMMON), ~sure & (times >= COMMON)
            i = np.flatnonzero(open_)
            bucket = (gram[i] % np.uint64(4 * buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            i, bucket = i[order], bucket[order]
            for a, b in _runs(bucket):
                j = i[a:b]
                head = np.stack((gram[j].view(np.int64), mine[j], (place - here)[j]), axis=1)
                body = t.buffer[begin[j][:, None] + np.arange(2 * LENGTH - GRAM)]
                yield _kind(1, int(bucket[a]), r["part"], head, body, np.stack((before[j], after[j]), axis=1).astype(np.uint8), doc[j])
            i = np.flatnonzero(common)
            if len(i):
                start = np.unique((begin[i][:, None] + np.arange(LENGTH - GRAM + 1)).ravel())
                d = np.searchsorted(t.starts, start, "right") - 1
                fits = (d >= 0) & (start + LENGTH <= (t.starts + t.sizes)[d])
                start, d = start[fits], d[fits]
                h, g = t.hashed(start, LENGTH)
                yield _kind(2, 0, r["part"], h, ids[d], d, start - t.starts[d], g)

    seen = shown.join(least.withColumnRenamed("got", "least"), "part", "left")
    kinds = stored(seen.mapInArrow(decided, "kind int, bucket int, part long, a binary, b binary, c binary, d binary, e binary"), "decided", ["kind"])
    sure = kinds.where("kind = 0").select("part", "a", "b")
    ends = kinds.where("kind = 1").select("bucket", "part", "a", "b", "c", "d").groupBy("bucket").applyInArrow(_spans_of_contexts, "part long, a binary, b binary")
    windows = kinds.where("kind = 2").select("part", "a", "b", "c", "d", "e")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            keys, checks, docs = _smallest(*(np.frombuffer(r[k], t) for k, t in (("a", "<u8"), ("e", "<u8"), ("b", "<i8"))))
            yield from _dealt((keys % np.uint64(buckets)).astype(np.int64), r["part"], [keys, docs, checks], _CHECKED)

    answers = _meet(windows.mapInArrow(told, "bucket int, part long, a binary, b binary, c binary"), _least, "windows", "abc")

    def heard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            keys, docs, row, begin, checks = (np.frombuffer(r[k], t) for k, t in (("a", "<u8"), ("b", "<i8"), ("c", "<i8"), ("d", "<i8"), ("e", "<u8")))
            sure = np.minimum(_known(keys, checks, _smallest(keys, checks, docs)), _known(keys, checks, _joined(r["got"]))) < docs
            key, reach = _merged(row[sure], begin[sure], begin[sure] + LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((r["part"], key.tobytes(), reach.tobytes()), _SPANS.types)], schema=_SPANS)

    common = windows.join(answers, "part", "left").mapInArrow(heard, "part long, a binary, b binary")
    every = sure.unionByName(ends).unionByName(common)
    out = stored(every.groupBy("part").agg(F.collect_list(F.struct("a", "b")).alias("got")), "spans")
    forget(known, least, kinds, answers)
    return out


def _kind(kind: int, bucket: int, part: int, *blobs: np.ndarray) -> pa.RecordBatch:
    row = (kind, bucket, part, *[np.ascontiguousarray(x).tobytes() for x in blobs], *[b""] * (5 - len(blobs)))
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _KINDS.types)], schema=_KINDS)


def _runs(sorted_: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(sorted_, prepend=-1)).tolist()
    return list(zip(cut, [*cut[1:], len(sorted_)]))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs, and with with_text the bytes kept.

    Strings are judged on the input; matches never cross documents. A null text is the empty one; texts under 50 bytes
    keep all; rows of one id are not smaller than each other, so copies under one id stay; a null id is the smallest.
    """
    spark: SparkSession = docs.sparkSession
    parts = parts_of(texts(docs, id_col, text_col))
    size = parts.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x))).first()[0] or 0
    # a bucket's blobs are one table in memory, so there are as many as the texts' bytes ask for
    spans = _spans(parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_task()
        for r in _rows(batches):
            t, _ = _texts(r)
            keys = [np.frombuffer(x["a"], "<i8") for x in r["got"] or ()]
            ends = [np.frombuffer(x["b"], "<i8") for x in r["got"] or ()]
            key, reach = np.concatenate(keys or [np.empty(0, np.int64)]), np.concatenate(ends or [np.empty(0, np.int64)])
            key, reach = _merged(key >> 40, key & ((1 << 40) - 1), reach)
            row, begin = key >> 40, key & ((1 << 40) - 1)
            cut = np.searchsorted(row, np.arange(len(t.sizes) + 1)).tolist()
            raw, out = t.buffer.tobytes(), []
            for i, (start, size) in enumerate(zip(t.starts.tolist(), t.sizes.tolist())):
                kept, at = [], start
                for a, b in zip(begin[cut[i] : cut[i + 1]].tolist(), reach[cut[i] : cut[i + 1]].tolist()):
                    kept.append(raw[at : start + a])
                    at = start + b
                body = b"".join((*kept, raw[at : start + size]))
                out.append((r["ids"][i], size, size - len(body), cut[i + 1] - cut[i], hashlib.sha256(body).hexdigest(), *([body] if with_text else [])))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    fields = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return parts.join(spans, "part", "left").mapInArrow(run, fields)
