"""The pipeline's stages on odd tables, and its rows against a chain of brute force."""

import random
import re
import zlib
from collections import Counter
from math import floor

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import WORDS, brute_counts, brute_probability, target_of

from corpusgraph.llm import mixing, quality, token_ids
from corpusgraph.llm.common import ship

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of documents with junk, near copies, benchmark passages, nulls and repeated rows, and what belongs to it."""
    ship(spark)
    rng, where = random.Random(3), str(tmp_path_factory.mktemp("tables"))
    good = ["".join(rng.choices("abcdefgéж", k=rng.randint(2, 8))) for _ in range(300)]
    junk = ["".join(rng.choices("xyzq0189#", k=rng.randint(2, 8))) for _ in range(300)]
    items = [(i, " ".join(rng.choices(good, k=rng.randint(12, 30)))) for i in range(6)] + [(6, None), (7, "")]
    rows, labels, junky = [], [], set()
    for i in range(260):
        bad = i % 3 == 2
        w = rng.choices(junk if bad else good, k=rng.randint(40, 160))
        if i % 7 == 3 and rows:
            k = rng.randrange(len(rows))
            w, bad = rows[k][1].split(" "), k in junky
            for _ in range(rng.choice((0, 1, 2, 6))):
                w[rng.randrange(len(w))] = rng.choice(good)
        if i % 11 == 6:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(items[:6])[1].upper()]
        junky |= {i} if bad else set()
        rows.append((i, " ".join(w), "en", rng.choice(["a", "a", "b", "é", None]), 1))
        if i % 6:
            labels.append((i, int(not bad), None))
    rows += [(400, None, "en", "a", None), (401, "", None, None, 0), (None, " ".join(rng.choices(good, k=80)), "en", "a", 1), rows[0], rows[0], (402, rows[1][1], "de", "b", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def near_groups(rows):
    """For each row the smallest id that Jaccard similarity 0.8 or more of 5-word shingles reaches."""
    low = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))

    def shingles(text):
        w = WORDS.findall((text or "").encode().translate(low))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    least = {}
    for k, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root[k]] = min(least.get(root[k], r["doc_id"]), r["doc_id"])
    return [least.get(root[k]) for k in range(len(rows))]


def holds(text, item):
    """Whether an item of the benchmark stands in a text with at most a tenth of its characters as edits."""
    plain = lambda t: re.sub("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", (t or "").lower()).strip(" ")
    x, y = plain(item), np.array([ord(c) for c in plain(text)])
    if len(x) < 24:
        return False
    row = np.zeros(len(y) + 1, int)
    steps = np.arange(len(y) + 1)
    for c in x:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (y != ord(c)))
        row = np.minimum.accumulate(new - steps) + steps
    return row.min() <= len(x) // 10


def test_run_against_brute_force(spark, tables):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    left = []
    for r in docs.collect():
        c = brute_counts(r["text"])
        if c[0] >= 50 and 100 * c[4] <= 50 * c[0] and brute_probability(r["text"], model) >= quality.KEEP_FROM:
            left.append(r)
    assert 60 < len(left) < docs.count() - 20
    groups = near_groups(left)
    left = list({tuple(r): r for r, g in zip(left, groups) if r["doc_id"] is None or r["doc_id"] == g}.values())
    items = [r["text"] for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in left if any(holds(r["text"], x) for x in items)}
    assert held and None not in held
    left = [r for r in left if r["doc_id"] not in held]
    # the mix as systematic sampling over each source in the order of size: what each size class gets
    size = lambda r: len(WORDS.findall((r["text"] or "").encode()))
    sizes = Counter()
    for r in left:
        sizes[r["source"]] += size(r)
    target = target_of(sizes)
    offset = {r["source"]: r["o"] for r in spark.createDataFrame([(s,) for s in sizes], "source string").select("source", (F.pmod(F.xxhash64(F.lit(42), "source"), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("o")).collect()}
    want = Counter()
    for s in sizes:
        rate, before = min(3.0, target[s] / sizes[s]), 0
        for z, n in sorted(Counter(size(r) for r in left if r["source"] == s).items()):
            want[s, z] = floor((before + n) * rate + offset[s]) - floor(before * rate + offset[s])
            before += n
    got = corpus_pipeline.run(spark, tables).collect()
    tok = Tokenizer.from_file(token_ids.default_tokenizer())
    ids = {(r["doc_id"], crc(tok, r["text"])[1]): r for r in left}
    taken, at = Counter(), 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert (r["start"], r["n_tokens"]) == (at, crc(tok, ids[r["doc_id"], r["ids_crc32"]]["text"])[0])
        at += r["n_tokens"]
        d = ids[r["doc_id"], r["ids_crc32"]]
        taken[d["source"], size(d)] += 1
    assert taken == +want
    assert Counter(map(tuple, corpus_pipeline.run(spark, tables).collect())) == Counter(map(tuple, got))


def crc(tok, text):
    ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
    return len(ids), zlib.crc32(ids.tobytes())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_tables(spark, tables, name, stage):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with our own names; and no rows."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    long = docs.where("doc_id < 3").select((F.col("doc_id") + 500).alias("doc_id"), F.repeat(F.concat("text", F.lit(" ")), 400).alias("text"), "lang", "source", "n_chars")
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, COLUMNS)
    odd = docs.unionByName(long).unionByName(nulls)
    for c in ("id", "fp", "h", "part", "size", "copies", "judged", "component", "c0", "c1", "n", "key", "start", "__drop", "__bad", "__id", "__n"):
        odd = odd.withColumn(c, F.lit("x"))
    out = stage(spark, odd, tables)
    if name == "token_output":
        assert out.count() == odd.count()
    else:
        assert out.columns == odd.columns and out.count() > 0
        if name != "mixing_sources":
            assert out.exceptAll(odd).count() == 0
    assert stage(spark, odd.limit(0), tables).count() == 0
