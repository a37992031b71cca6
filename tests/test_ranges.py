"""Sums along an order and what is built on them: budgets and shards."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import ranking as K
from corpusgraph.sources import corpus as S


def _docs(spark, keys, kind, seed=1):
    rng = random.Random(seed)
    rows = [(k, "x" * rng.choice([0, 1, 7, 40])) for k in keys]
    return spark.createDataFrame(rows, f"k {kind}, text string").repartition(5), sorted(rows)


_RNG = random.Random(2)
SPARSE = [_RNG.getrandbits(62) - (1 << 61) for _ in range(500)]


@pytest.mark.parametrize("kind,keys", [("long", SPARSE), ("string", [f"{x:x}" for x in SPARSE]), ("long", list(range(3)))])
def test_running_sum_and_budget(spark, kind, keys):
    df, rows = _docs(spark, keys, kind)
    got = {r["k"]: r["before"] for r in K.running_sum(df.withColumn("n", F.length("text")), ["k"], "n").collect()}
    before, want = 0, {}
    for k, t in rows:
        want[k] = before
        before += len(t)
    assert got == want
    for most in (0, 100, 1500, 10**9):
        taken, size = [], 0
        for k, t in rows:
            taken.append((k, t[:20]))
            size += len(t[:20])
            if size > most:
                break
        assert sorted(map(tuple, K.char_budget_sample(df, "k", "text", 20, most).collect())) == taken
    assert K.char_budget_sample(df.limit(0), "k", "text", 20, 5).count() == 0 == K.running_sum(df.limit(0).withColumn("n", F.length("text")), ["k"], "n").count()


@pytest.mark.parametrize("chars,group", [(400, 4), (1, 3), (3000, 1), (10**9, 16)])
def test_shards_close_when_full(spark, chars, group):
    df, rows = _docs(spark, SPARSE, "long", 3)
    got = S.shard_rows(df, "k", "text", chars, group, run=3).collect()
    assert sorted((r["k"], r["text"]) for r in got) == rows
    assert [r["place"] for r in sorted(got, key=lambda r: r["place"])] == list(range(len(rows)))
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    last = max(shards)
    for name, of in shards.items():
        if name != last:  # the rest
            assert sum(len(r["text"]) for r in of) >= chars and len(of) % group == 0
            of.sort(key=lambda r: r["place"])
            if not name.startswith("rest"):  # nor did it close later than it could
                assert sum(len(r["text"]) for r in of[:-group]) < chars
    assert S.shard_rows(df.limit(0), "k", "text", chars, group).count() == 0


def test_shard_files(spark, tmp_path):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 30).alias("text"))
    S.write_shards(docs, str(tmp_path / "s"), shard_chars=300_000, group=1024)
    files = sorted(Path(tmp_path / "s").rglob("*.parquet"))
    assert len(files) == len(list(Path(tmp_path / "s").glob("shard=*"))) == 3
    for f in files:
        meta = pq.ParquetFile(f).metadata
        assert meta.num_rows in (2048, 904)
        for g in range(meta.num_row_groups):
            column = meta.row_group(g).column(0)
            assert meta.row_group(g).num_rows <= 1024 and column.compression == "ZSTD" and column.statistics is None
            assert not any("DICT" in e for e in column.encodings)
    assert S.read_corpus(spark, str(tmp_path / "s"), "val").count() == 904 and S.read_corpus(spark, str(tmp_path / "s")).count() == 4096


def test_history_of_equal_times(spark):
    rows = [(1, 5, 2, "user", "b"), (1, 5, 1, "user", "a"), (1, 4, 9, "user", "old"), (1, 5, 3, "assistant", "c")]
    df = spark.createDataFrame(rows, "session long, at long, log_id long, role string, text string")
    assert K.recent_history(df, ["session"], ["at", "log_id"], 3).collect()[0]["history"] == "USER: a\nUSER: b\nASSISTANT: c"
