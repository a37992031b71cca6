"""Operator 8: quality rules. Counts with fixed limits, then a calibrated logistic regression over hashed word and
character n-grams, trained on labelled rows and scored in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import begin, forget, stored, texts

#: Features of each of the two kinds, character and word n-grams. On held-out labels 4,096 to 32,768 did alike.
BITS = 13
FEATURES = 1 << BITS
#: At most so many labelled rows train the model, chosen by the hash of their id.
MAX_LABELLED = 12_000
#: Partitions of that sample: its fit is many short jobs, each of so many tasks.
PARTS = 4
#: The calibrated probability from which a text is kept.
KEEP_FROM = 0.5
SCALE = 30.0
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    threes = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(threes)) < len(threes):
        found, covered = Counter(threes), 0
        for i, three in enumerate(threes):
            if found[three] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated


def ngrams(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text's UTF-8 bytes: of its 4-byte grams, and of its words and word pairs."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    chars = np.empty(0, np.int64)
    if n >= 4:
        g = b[:-3].astype(np.uint32) | b[1:-2].astype(np.uint32) << 8 | b[2:-1].astype(np.uint32) << 16 | b[3:].astype(np.uint32) << 24
        chars = (g * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64)
    space = np.ones(n + 2, bool)
    space[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return chars, np.empty(0, np.int64)
    # a word's hash: its length, first three and last three bytes, and the sum of its bytes' odd multiples
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = b
    mixed = np.zeros(n + 1, np.uint32)
    np.cumsum(_MIX[b], out=mixed[1:])
    h = mixed[ends] - mixed[starts]
    for k in (0, 1, 2):
        h = h * np.uint32(31) + padded[starts + k] * (starts + k < ends)
        h = h * np.uint32(37) + padded[np.maximum(ends - 1 - k, 0)] * (ends - 1 - k >= starts)
    h = h.astype(np.uint32) * np.uint32(0x85EBCA6B)
    pairs = (h[:-1] ^ (h[1:] >> np.uint32(7))) * np.uint32(0xC2B2AE35)
    return chars, FEATURES + (np.concatenate((h, pairs)) >> np.uint32(32 - BITS)).astype(np.int64)


_MIX = (np.arange(1, 257, dtype=np.uint32) * np.uint32(2654435761) ^ np.uint32(0x5BD1E995)).astype(np.uint32)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature, value): the mean count of each hashed feature, kind by kind, times SCALE."""
    parts = [(np.empty(0, np.int64), np.empty(0))]
    for f in ngrams(text.encode("utf-8", "surrogatepass")):
        if len(f):
            at, n = np.unique(f, return_counts=True)
            parts.append((at, SCALE * n / len(f)))
    return tuple(np.concatenate(x) for x in zip(*parts))


_VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label, held) -> (features, label, held), a few rows at a time; features has the fields of a sparse vector."""
    begin()
    for batch in batches:
        for at in range(0, batch.num_rows, 50):
            part = batch.slice(at, 50)
            made = [features(x) for x in part.column(0).to_pylist()]
            n = len(made)
            vector = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, 2 * FEATURES, np.int32)), pa.array([i for i, _ in made], _VECTOR[2].type), pa.array([v for _, v in made], _VECTOR[3].type)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(vector, fields=list(_VECTOR)), part.column(1), part.column(2)], names=["features", "label", "held"])


@dataclass
class Model:
    """Weights of the features, the intercept, and the slope and offset that turn a score into a probability."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, text: str) -> float:
        score = self.intercept
        for f in ngrams(text.encode("utf-8", "surrogatepass")):
            if len(f):
                score += SCALE * float(self.weights[f].mean(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -40, 40))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model | None:
    """A model from at most max_labelled labelled rows; None if a class is missing among them.

    A row that is labelled twice takes the lower label; null labels and ids don't count. Every fifth row (by hash) is
    held out to fit the calibration.
    """
    picked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    # at most max_labelled rows of two numbers: small enough for a broadcast by its limit
    sample = texts(docs, id_col, text_col).join(F.broadcast(picked), "id")
    sample = sample.select("text", "label", (F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(5)) == 0).alias("held"))
    made = stored(sample.mapInArrow(_described, "features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>, label double, held boolean"), "labelled")
    # a sparse vector is stored as these fields, so the table is read as one of vectors
    schema = StructType([StructField("features", VectorUDT()), *made.schema.fields[1:]])
    rows = docs.sparkSession.read.schema(schema).parquet(made._stored_at).coalesce(PARTS)
    seen = {(r["held"], r["label"]) for r in rows.groupBy("held", "label").count().collect()}
    if not {(False, 0.0), (False, 1.0)} <= seen:
        forget(made)
        return None
    fit = LogisticRegression(maxIter=60, regParam=2e-4, standardization=False, tol=1e-5).fit(rows.where("not held"))
    model = Model(fit.coefficients.toArray().astype(np.float32), float(fit.intercept))
    if {(True, 0.0), (True, 1.0)} <= seen:
        model.slope, model.offset = _platt(fit, rows.where("held"))
    forget(made)
    return model


def _platt(fit, held: DataFrame) -> tuple[float, float]:
    """Slope and offset of Platt's scaling over held-out rows, of which the sample's bound is a bound."""
    from pyspark.ml.functions import vector_to_array

    got = fit.transform(held).select(vector_to_array("rawPrediction")[1].alias("s"), "label").toPandas()
    s, up = got["s"].to_numpy(), got["label"].to_numpy() > 0
    y = np.where(up, (up.sum() + 1) / (up.sum() + 2), 1 / ((~up).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[np.sum(w * s * s) + 1e-6, np.sum(w * s)], [np.sum(w * s), np.sum(w) + 1e-6]])
        step = np.linalg.solve(hess, np.array([np.sum((p - y) * s) + 1e-6 * (a - 1), np.sum(p - y)]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 and np.isfinite(a + b) else (1.0, 0.0)


def judge(docs: DataFrame, model: Model | None, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """docs with one more column `judged`: a struct of the counts, probability, base_failed and kept.

    base_failed: under 50 words, or over half of them in repeated three-word windows. A null text has no words. Without
    a model the counts decide alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf(f"struct<{STATS.replace(' long', ': long')}, probability: double, base_failed: boolean, kept: boolean>")
    def udf(text: pd.Series) -> pd.DataFrame:
        begin()
        model, out = sent.value, []
        for x in text:
            c = counts(x)
            failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
            p = 1.0 if model is None else model.probability(x)
            out.append((*c, p, failed, not failed and p >= keep_from))
        return pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability", "base_failed", "kept"])

    return docs.withColumn("judged", udf(F.coalesce(F.col(text_col), F.lit(""))))


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, probability, base_failed, kept) of each row of docs."""
    model = train(docs, labels, id_col, text_col)
    return judge(texts(docs, id_col, text_col), model).select("id", "judged.*")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])  # a column of docs may be named as ours
    text = f"c{names.index(text_col)}"
    kept = judge(renamed, train(docs, labels, id_col, text_col), text).where("judged.kept")
    return kept.drop("judged").toDF(*names)
