"""The n-gram join, hard negatives and cross-tokenizer alignment against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from test_operators import WORDS, corpus, frame

from corpusgraph.llm import alignment, hard_negatives, prefix_tree
from corpusgraph.llm.common import ship


@pytest.fixture(autouse=True)
def _ship(spark):
    ship(spark)


def shingles_of(text, words=3):
    low = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
    w = WORDS.findall((text or "").encode().translate(low))
    k = min(words, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def least_reached(sets, ids, near):
    """The smallest id of each row's component, by flooding over all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if near(a, sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(sets)):
        known = [x for x in (least.get(find(i)), ids[i]) if x is not None]
        least[find(i)] = min(known, default=None)
    return [least[find(i)] for i in range(len(sets))]


def test_ngram_join(spark):
    rng = random.Random(3)
    rows = corpus(4)
    vocab = [f"w{k}" for k in range(400)]
    for k in range(4):  # chains of near copies around the limit, some of them far from each other
        words = rng.choices(vocab, k=120)
        for _ in range(25):
            words = [w if rng.random() > 0.012 else rng.choice(vocab) for w in words]
            rows.append((1000 + len(rows), " ".join(words).upper() if k == 2 else "\t".join(words), "a"))
    rows += [(None, rows[0][1], "a"), (None, "alone without an id", None), (2000, "ONE", "a")]
    sets = [shingles_of(t) for _, t, _ in rows]
    near = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 90 * len(a | b)
    want = sorted(zip([r[0] for r in rows], map(len, sets), least_reached(sets, [r[0] for r in rows], near)), key=repr)
    got = sorted(map(tuple, prefix_tree.classes(frame(spark, rows)).collect()), key=repr)
    assert got == want and len({w[2] for w in want}) < len(want) - 60
    assert prefix_tree.classes(frame(spark, [])).count() == 0


def test_ngram_join_across_blocks(spark, monkeypatch):
    """Blocks of a few sets, so that most links run between blocks."""
    monkeypatch.setattr(prefix_tree, "BLOCK", 4)
    rng, vocab, rows = random.Random(6), [f"w{k}" for k in range(90)], []
    base = rng.choices(vocab, k=70)
    for k in range(120):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(70)] = rng.choice(vocab)
        rows.append((k, " ".join(words), "a"))
    sets = [shingles_of(t) for _, t, _ in rows]
    near = lambda a, b: 100 * len(a & b) >= 90 * len(a | b)
    got = {r["id"]: r["component"] for r in prefix_tree.classes(frame(spark, rows)).collect()}
    want = least_reached(sets, list(range(120)), near)
    assert [got[k] for k in range(120)] == want and 1 < len(set(want)) < 120


@pytest.mark.parametrize("percent", [80, 90])
def test_keys_shared_by_sets_of_other_sizes_alone_are_left_out(spark, percent):
    """A key whose sets can't be partners by their sizes makes no rows; those that can be are all kept, in one shuffle."""
    rng = random.Random(8)
    rows = [(rng.randrange(60), fp, rng.choice((1, 9, 10, 11, 80, 100, 101, 125, 500))) for fp in range(150)]
    placed = spark.createDataFrame(rows, "key long, fp long, n int")
    fit = lambda a, b: 100 * min(a, b) >= percent * max(a, b)
    want = {(k, f, n) for k, f, n in rows if any(k == k2 and f != f2 and fit(n, n2) for k2, f2, n2 in rows)}
    made = prefix_tree.beside(placed, percent)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = made.collect()
    assert {(r["key"], r["fp"], r["n"]) for r in got} == want and len(got) == len(want) < len(rows)
    assert all(r["after"] is None or fit(r["n"], r["after"]["n"]) and (r["key"], r["after"]["fp"], r["after"]["n"]) in want for r in got)


@pytest.mark.parametrize("probes", [None, 9])
def test_prefix_tree_finds_a_spanning_forest(probes):
    rng = random.Random(7)
    for _ in range(30):
        base, sets = [rng.sample(range(10**6), rng.randint(1, 60)) for _ in range(3)], []
        while len(sets) < 25:
            s = {x for x in rng.choice(base) if rng.random() > 0.03} | {rng.randrange(10**6) for _ in range(rng.randint(0, 2))}
            if s:
                sets.append(np.array(sorted(s), np.int64))
        across = lambda i, j: probes is None or (i < probes) != (j < probes)
        near = [(i, j) for i in range(25) for j in range(i) if across(i, j) and 190 * len(np.intersect1d(sets[i], sets[j])) >= 90 * (len(sets[i]) + len(sets[j]))]
        got = prefix_tree.tree_links(sets, list(range(25)), 90, probes)
        assert {tuple(sorted(x, reverse=True)) for x in got} <= set(near)
        parts = lambda links: least_reached(list(range(25)), list(range(25)), lambda a, b: (a, b) in links)
        assert parts({tuple(sorted(x, reverse=True)) for x in got}) == parts(set(near)) and len(got) == 25 - len(set(parts(set(near))))


# Hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    ok = [(k, i, lab, [int(np.floor(256 * float(x))) for x in v]) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda s, i: (-s, i is None, i or 0)
    out = []
    for k, i, lab, v in ok:
        if i is None or not is_anchor(i):
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, other) for m, j, other, w in ok if m != k]
        best = sorted(((s, j) for s, j, other in score if other == lab), key=lambda x: key(*x))[:positives]
        for ps, pj in best:
            fit = sorted(((s, j) for s, j, other in score if other != lab and low * ps <= 100 * s <= high * ps), key=lambda x: key(*x))[:negatives]
            out += [(i, pj, r, j, ps, s) for r, (s, j) in enumerate(fit, 1)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, uid string, id string, v string, number string"


def vectors(rng, n=400, dims=12):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]
        v = [x * rng.choice([0.2, 1, 3]) for x in v] if i % 3 else [float(round(x)) for x in v]
        rows.append((i, v, rng.randrange(4)))
    same = [1.0] * dims
    rows += [(n + i, same, i % 2) for i in range(60)]  # one very common vector, so ties by id
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (910, [nan] * dims, 1), (920, [inf] + [0.0] * (dims - 1), 1), (930, [None] + [0.0] * (dims - 1), 1), (940, same, None), (None, same, 2), (950, [], 1), (960, [0.0] * dims, 2), (970, [2.0], 1), (980, [-9.0] * dims, 3)]
    return rows + [rows[20], rows[0], (None, rows[20][1], 1)]


def test_vectors_that_compress_well_are_not_broadcast(spark):
    """Copies make small files of many vectors; these move to where blocks meet them, not through the driver."""
    rows = spark.range(3_000).selectExpr("id as vec_id", "array_repeat(float(0.5 + id % 7 / 10), 64) as embedding", "int(id % 3) as label")
    found = hard_negatives.mine(hard_negatives.prepared(rows), hard_negatives.F.col("id") % 50 == 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join [pack" in line or "Join [number" in line)
    assert "SortMergeJoin" in join and found.count() > 0


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PACK", 50)
    monkeypatch.setattr(hard_negatives, "BUCKET", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rows = vectors(random.Random(8))
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTORS)
    got = hard_negatives.mine(hard_negatives.prepared(df), hard_negatives.F.col("id") % 10 == 0)
    got = sorted(map(tuple, got.collect()), key=repr)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert got == want and len(want) > 300
    assert hard_negatives.mine(hard_negatives.prepared(df.limit(0)), hard_negatives.F.col("id") % 10 == 0).count() == 0


def test_coordinate_ranges_lose_no_row():
    rng, used = np.random.default_rng(9), 0
    rows = rng.normal(0, 1, (600, 8))
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1, keepdims=True) * rng.choice([1, 4], (600, 1))).astype(np.int32)
    rows = rows[np.argsort(-(rows.astype(float) ** 2).sum(1), kind="stable")]
    buckets, ids = hard_negatives.buckets_of(rows, 64), np.arange(600)
    for a in (rows[::7] // 2).astype(np.int32):
        score = rows.astype(np.int64) @ a.astype(np.int64)
        for cosine in (0.3, 0.7, 0.9, 0.99):
            unit = a / np.linalg.norm(a)
            for b in buckets:
                some = b.candidates(unit, np.argsort(-np.abs(unit))[:4], cosine)
                near = np.flatnonzero(b.rows @ unit >= cosine * b.lengths)
                used += some is not None
                assert some is None or set(near) <= set(some)
        lo = int(100 * np.sort(score)[-40])
        want = sorted((-int(s), int(i), int(i)) for i, s in enumerate(score) if 100 * s >= lo)[:6]
        assert hard_negatives.search(a, -1, [(lo, 1 << 62)], 6, buckets, ids, ids)[0] == want
    assert used > 1000


# Alignment of two tokenizers


def brute_alignment(texts):
    """Whole texts encoded at once, groups by sets of ends, links by all pairs of tokens."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = alignment._unbyte()
    made = []
    for text in texts:
        a, b = one.encode(" " + (text or ""), add_special_tokens=False).ids, two.encode(text or "")
        xs = [bytes(byte[c] for c in one.id_to_token(k)) for k in a]
        ys = [bytes([int(p[3:5], 16)]) if two.is_byte(k) else p.replace("\u2581", " ").encode() for k, p in zip(b, map(two.id_to_piece, b))]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(xs) != raw or b"".join(ys) != raw:
            made.append(None)
            continue
        ea, eb = np.cumsum([*map(len, xs)]), np.cumsum([*map(len, ys)])
        cuts = np.intersect1d(ea, eb)
        ga, gb = np.searchsorted(cuts, ea), np.searchsorted(cuts, eb)
        said = ";".join(f"{','.join(str(k) for k, g in zip(a, ga) if g == c)}|{','.join(str(k) for k, g in zip(b, gb) if g == c)}" for c in range(len(cuts)))
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(ea[i] - len(xs[i]), eb[j] - len(ys[j])) < min(ea[i], eb[j])]
        made.append((len(a), len(b), len(cuts), links, said))
    count = Counter(p for m in made if m for p in set(m[3]))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if m is None else (*m[:3], len(m[3]), sum(count[p] == most[p[0]] for p in m[3]), sum(count[p] for p in m[3]), hashlib.sha256(m[4].encode()).hexdigest()) for m in made]


ODD = ["\u2581x", "a\u2581b c", "  two  spaces ", "tab\tand\r\nline\n\nfeeds \n x", "na\u00efve fa\u00e7ade \u65e5\u672c\u8a9e \U0001f600 \u0e2a\u0e27\u0e31", "<|endoftext|> <s> </s> <unk> <0x0A>", "\x00 \x1c \xa0 \u3000 x", "'s don't I'LL 123456789 3.14", "e\u0301 \u0301x y", " ", "\n", "x" * 3000, "a" + " " * 50 + "b", "\ufb01 \u00bd \u2028 z"]


def test_alignment(spark, monkeypatch):
    rows = [r for r in corpus(10) if len(r[1] or "") < 5000] + [(100 + k, x, "a") for k, x in enumerate(ODD)]
    rows += [(None, "no id", "a"), rows[1], (300, "word " * 400 + "end", "a")]
    want = Counter((i, *w) for (i, _, _), w in zip(rows, brute_alignment([r[1] for r in rows])))
    for hot in (100_000, 7, 0):  # all pairs hot, most of them joined, all joined
        monkeypatch.setattr(alignment, "HOT", hot)
        assert Counter(map(tuple, alignment.align(frame(spark, rows))[0].collect())) == want
    found, pairs = alignment.align(frame(spark, []))
    assert found.count() == pairs.count() == 0


def test_alignment_forgets_parts_and_reads_whole_texts():
    pair = alignment.Pair(*alignment.default_tokenizers(), keep=5)
    whole = alignment.Pair(*alignment.default_tokenizers())
    whole.in_parts = False
    docs = [x[1] or "" for x in corpus(11) if len(x[1] or "") < 5000] + ODD
    for at in range(0, len(docs), 9):
        some = docs[at : at + 9]
        for text, got, want in zip(some, pair.documents(some), whole.documents(some)):
            assert got[:5] == want[:5] and (got[5] == want[5]).all() and (got[6] == want[6]).all(), text


def test_groups_by_divide_and_conquer():
    rng = random.Random(12)
    for _ in range(300):
        end = rng.randint(1, 60)
        a, b = (sorted({*rng.sample(range(1, end + 1), rng.randint(0, end)), end}) for _ in range(2))
        cuts, groups = sorted(set(a) & set(b)), alignment.groups_of(a, b)
        assert [a[x[1] - 1] for x in groups] == [b[x[3] - 1] for x in groups] == cuts
        assert [x[0] for x in groups] == [0, *(x[1] for x in groups[:-1])] and [x[2] for x in groups] == [0, *(x[3] for x in groups[:-1])]
    assert alignment.groups_of([], []) == []
