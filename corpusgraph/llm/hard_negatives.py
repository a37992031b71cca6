"""Operator 12: hard negatives by coordinate pruning (LEMP: Teflioudi, Gemulla and Mykytiuk, 2015).

Vectors are integers, so scores are exact. The rows of a label are ordered by length and cut into packs; a pack is cut into
length buckets, which hold their rows' direction in sorted lists, one for each coordinate. An anchor that needs a score of
t from a bucket whose longest row has length l needs a cosine of t / (|anchor| l): that leaves a range of values at each
coordinate, widest where the anchor is small. The ranges at its largest coordinates, the focus, are looked up in the
sorted lists and intersected, and what is left is scored exactly. A bucket that is too short for t ends the pack.

Blocks of anchors meet packs, so no row goes with every anchor through a shuffle: packs move once, anchors once for each
pack that they search. t is the least score that an anchor can still use: the k-th best of the pack so far, or the lower
end of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, forget, stored

#: Rows of a pack and of a length bucket, anchors of a block, coordinates of an anchor that are looked up.
PACK, BUCKET, ANCHORS, FOCUS = 8_192, 1_024, 512, 4
#: Components are counted in 256ths up to this size; larger ones count as it, so that a score fits a long.
MOST = 1 << 25
NO_ID, FAR = (1 << 63) - 1, (1 << 62)


class Bucket:
    """Rows of about one length, with sorted lists of their directions' coordinates."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray, first: int):
        self.rows, self.lengths, self.first, self.longest = rows, lengths, first, float(lengths.max())
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            x = self.rows[:, f] / np.maximum(self.lengths, 1.0)  # a row without length is in no range; see candidates()
            order = np.argsort(x, kind="stable")
            self.lists[f] = x[order], order
        return self.lists[f]

    def candidates(self, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows whose direction can have this cosine (over 0) with unit; None for all."""
        spans = []
        for f in focus.tolist():
            a = float(unit[f])
            reach = np.sqrt(max(0.0, (1 - a * a) * (1 - cosine * cosine)))
            values, order = self.sorted_list(f)
            lo, hi = np.searchsorted(values, [a * cosine - reach - 1e-9, a * cosine + reach + 1e-9])
            # the range of a cosine of at least t: up to the end on the anchor's side once a is the larger
            if a > cosine:
                hi = np.searchsorted(values, 1.0 + 1e-9)
            if -a > cosine:
                lo = 0
            spans.append((int(hi) - int(lo), int(lo), int(hi), order))
        spans.sort(key=lambda s: s[0])
        if 2 * spans[0][0] > len(self.lengths):
            return None
        met = np.zeros(len(self.lengths), np.int8)
        for _, lo, hi, order in spans:
            met[order[lo:hi]] += 1
        return np.flatnonzero(met == len(spans))


def buckets_of(matrix: np.ndarray, size: int = BUCKET) -> list[Bucket]:
    """Buckets of rows that come in order of length, longest first."""
    lengths = np.sqrt((matrix.astype(np.float64) ** 2).sum(1))
    return [Bucket(matrix[at : at + size], lengths[at : at + size], at) for at in range(0, len(matrix), size)]


def _exact(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; floating point is used where every sum is below 2 ** 53."""
    if rows.size and float(np.abs(rows).max()) * float(np.abs(anchor).max()) * max(1, rows.shape[1]) < 2.0**53:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return rows.astype(np.int64) @ anchor.astype(np.int64)


def search(anchor: np.ndarray, uid: int, windows: list[tuple[int, int]], k: int, buckets: list[Bucket], uids: np.ndarray, ids: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each window (lo, hi): the first k rows (-score, id, uid) but uid itself with lo <= 100 score <= hi, higher
    scores first, ties by id."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in windows]
    length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
    unit = anchor / max(length, 1.0)
    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
    for b in buckets:
        need = min(max(lo, -100 * got[-1][0]) if len(got) == k else lo for (lo, _), got in zip(windows, found)) / 100
        if need > 0 and length * b.longest < need * (1 - 1e-9):
            break  # the rows to come are no longer than these
        some = b.candidates(unit, focus, min(1.0, need / (length * b.longest))) if need > 0 and len(focus) else None
        rows, at = (b.rows, np.arange(len(b.lengths))) if some is None else (b.rows[some], some)
        if not len(at):
            continue
        score = _exact(rows, anchor)
        at, cents = at + b.first, 100 * score
        for (lo, hi), got in zip(windows, found):
            fit = (cents >= lo) & (cents <= hi) & (uids[at] != uid)
            if len(got) == k:
                fit &= score >= -got[-1][0]
            where = np.flatnonzero(fit)
            if len(where) > k:  # ties at the k-th place stay until ids decide
                where = where[score[where] >= np.partition(score[where], -k)[-k]]
            if len(where):
                got += zip((-score[where]).tolist(), ids[at[where]].tolist(), uids[at[where]].tolist())
                got.sort()
                del got[k:]
    return found


def prepared(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(uid, id, label, v) of the rows that take part: those with a label and a vector of finite components alone."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), c.cast("double"))) * 256).cast("long"))).cast("int"))
    rows = embeddings.where(F.col(label_col).isNotNull() & x.isNotNull()).where(fine)
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))


_PACKED = pa.schema([("key", pa.string()), ("label", pa.int64()), ("dims", pa.int32()), ("uids", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("matrix", pa.binary()), ("lo", pa.list_(pa.list_(pa.int64()))), ("hi", pa.list_(pa.list_(pa.int64())))])
_PACKED_DDL = "key string, label long, dims int, uids array<long>, ids array<long>, matrix binary, lo array<array<long>>, hi array<array<long>>"


def _packs(rows: DataFrame, size: int) -> DataFrame:
    """Rows (uid, id, label, v, lo, hi) of a label, longest first, in packs of `size`."""
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    dealt = rows.select("uid", F.coalesce("id", F.lit(NO_ID)).alias("id"), "label", "v", "lo", "hi", squares.alias("squares"))
    order = F.col("label"), F.desc("squares"), F.col("uid")
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(part: list[tuple]) -> pa.RecordBatch:
        uids, ids, labels, vs, lo, hi = map(list, zip(*part))
        dims = max(map(len, vs))
        matrix = np.zeros((len(vs), dims), "<i4")  # shorter vectors have zeros at the end
        for i, v in enumerate(vs):
            matrix[i, : len(v)] = v
        row = [f"{labels[0]}-{uids[0]}"], [labels[0]], [dims], [uids], [ids], [matrix.tobytes()], [lo], [hi]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _PACKED.types)], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        part: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if part and (row[2] != part[0][2] or len(part) >= size):
                    yield pack(part)
                    part = []
                part.append(row)
        if part:
            yield pack(part)

    return dealt.mapInArrow(run, _PACKED_DDL)


def _searched(blocks: DataFrame, packs: DataFrame, met: Column, k: int) -> DataFrame:
    """(anchor, slot, score, id, uid): the first k rows of each pack that `met` lets a block b see (p), for each window.
    Keys and labels of packs alone go to all tasks, one for thousands of rows. Packs and blocks move to where they meet:
    files of like vectors are much smaller than the vectors, so a small file doesn't say that a table fits the driver."""
    named = F.broadcast(packs.select("key", "label")).alias("p")
    spread = blocks.alias("b").join(named, met).select("b.dims", "b.uids", "b.matrix", "b.lo", "b.hi", F.col("p.key").alias("pack"))
    spread = spread.repartition(int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pack")
    there = packs.select(F.col("key").alias("pack"), *[F.col(c).alias(f"p_{c}") for c in ("dims", "uids", "ids", "matrix")])
    both = spread.join(there.hint("merge"), "pack").select("dims", "uids", "matrix", "lo", "hi", "pack", "p_dims", "p_uids", "p_ids", "p_matrix")
    schema = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("uid", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        known = None
        for batch in batches:
            for i in range(batch.num_rows):
                dims, uids, matrix, lo, hi, key, p_dims, p_uids, p_ids, p_matrix = (batch.column(c)[i].as_py() for c in range(10))
                width = max(dims, p_dims)
                if known is None or known[0] != (key, width):
                    m = np.zeros((len(p_uids), width), np.int32)
                    m[:, :p_dims] = np.frombuffer(p_matrix, "<i4").reshape(len(p_uids), p_dims)
                    known = (key, width), buckets_of(m), np.array(p_uids, np.int64), np.array(p_ids, np.int64)
                anchors = np.zeros((len(uids), width), np.int32)
                anchors[:, :dims] = np.frombuffer(matrix, "<i4").reshape(len(uids), dims)
                out = []
                for a, uid, low, high in zip(anchors, uids, lo, hi):
                    for slot, got in enumerate(search(a, uid, list(zip(low, high)), k, *known[1:])):
                        out += [(uid, slot, -s, row_id, row) for s, row_id, row in got]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(schema.types)], schema=schema)

    found = both.mapInArrow(run, "anchor long, slot int, score long, id long, uid long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows(uid, id, label, v), as prepared()
    gives them; anchors says which rows are anchors.

    An anchor's positives are the first other rows of its label; for each, the first rows of other labels whose score is
    from `low` to `high` percent of the positive's. Higher scores come first, ties by smaller id, null ids last. Vectors of
    other lengths are compared as if zeros followed; components beyond 2 ** 17 count as that. Repeated rows count each,
    and a repeated anchor repeats its rows; an anchor without positives, positives without negatives and negative scores
    give no rows, nor does an empty table.
    """
    rows = stored(rows, "negatives_rows")
    none = F.array(F.lit(-FAR)), F.array(F.lit(FAR))
    packs = stored(_packs(rows.select("*", F.array().cast("array<long>").alias("lo"), F.array().cast("array<long>").alias("hi")), PACK), "negatives_packs")
    chosen = rows.where(anchors)
    blocks = _packs(chosen.select("*", none[0].alias("lo"), none[1].alias("hi")), ANCHORS)
    good = stored(_searched(blocks, packs, F.col("b.label") == F.col("p.label"), positives).select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score")), "negatives_good")
    # a window for each different score, as positives of one score have the same negatives
    slots = good.where("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    asked = chosen.join(slots, chosen["uid"] == slots["anchor"]).select("uid", "id", "label", "v", F.transform("scores", lambda s: low * s).alias("lo"), F.transform("scores", lambda s: high * s).alias("hi"))
    found = _searched(_packs(asked, ANCHORS), packs, F.col("b.label") != F.col("p.label"), negatives)
    of = slots.select("anchor", F.posexplode("scores").alias("slot", "positive_score"))
    bad = found.join(of, ["anchor", "slot"]).select("anchor", "positive_score", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    named = chosen.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = good.join(bad, ["anchor", "positive_score"]).join(named, "anchor")
    return out.select("anchor_id", real("positive").alias("positive_id"), "rank", real("negative").alias("negative_id"), "positive_score", "negative_score")
