"""The training-data operators against brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusgraph.llm import chat, decontaminate, html_extract, jaccard, line_dedup, mixing, quality, simhash, substrings, token_counts, token_ids
from corpusgraph.llm.common import ship
from corpusgraph.llm.components import components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, fp string, id string, part string, size string"


@pytest.fixture(autouse=True)
def _ship(spark):
    ship(spark)


def frame(spark, rows):
    """Documents with columns whose names clash with ours."""
    return spark.createDataFrame([(i, t, s, "x", "y", "z", "w") for i, t, s in rows], SCHEMA)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(120)]
    say = lambda k: " ".join(rng.choices(vocab, k=k))
    passage = say(30)
    rows = []
    for i in range(n):
        t = "\n".join(say(rng.randint(1, 25)) for _ in range(rng.randint(1, 5)))
        if i % 7 == 0:
            t += " " + passage + " " + say(3)
        if i % 11 == 5:
            t = rows[rng.randrange(len(rows))][1] or ""
        if i % 13 == 6:
            w = (rows[i - 3][1] or "x").split(" ")
            w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
        rows.append((i, t, rng.choice(["a", "b", "é", None])))
    rows += [(n, None, "a"), (n + 1, "", "b"), (n + 2, " \n\t ", None), (n + 3, "one", "a"), (n + 4, "x " * 30_000, "big"), (n + 5, rows[0][1], "a"), (3, rows[3][1], rows[3][2])]
    return rows


# SimHash


def brute_fp(text, words=4):
    low = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
    w = WORDS.findall((text or "").encode().translate(low))
    if not w:
        return 0
    k = min(words, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rows = corpus(1)
    got = {(r["id"], r["fp"] & (1 << 64) - 1, r["component"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    nodes = [(i, brute_fp(t)) for i, t, _ in rows]
    root = list(range(len(nodes)))
    for _ in nodes:
        for a, (_, x) in enumerate(nodes):
            for b, (_, y) in enumerate(nodes):
                if (x ^ y).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for k, (i, _) in enumerate(nodes):
        least[root[k]] = min(least.get(root[k], i), i)
    assert got == {(i, f, least[root[k]]) for k, (i, f) in enumerate(nodes)}


def test_simhash_links_are_complete(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for x in base:
        for _ in range(12):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            fps.add(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = [tuple(sorted((r["u"], r["v"]))) for r in simhash.links(df).collect()]
    fps = sorted(fps)
    want = {tuple(sorted((signed(a), signed(b)))) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_drop_near_duplicates(spark):
    rows = corpus(1)
    kept = simhash.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and 65 not in ids
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("sample", [1, 8])
def test_near_copies_by_shingles(spark, monkeypatch, sample):
    import corpus_pipeline

    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=60)
    rows = corpus(5)
    for g in range(12):
        base = rng.choices(vocab, k=rng.randint(60, 300)) + passage * (g % 2)
        for edits in (0, 1, 1, 2, 3, 4, 6, 8):
            w = list(base)
            for _ in range(edits):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 2)] = rng.choices(vocab, k=rng.randint(0, 2))
            rows.append((200 + len(rows), " ".join(w), "s"))
    low = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))

    def shingles(text):
        w = WORDS.findall((text or "").encode().translate(low))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    nodes = [(i, shingles(t)) for i, t, _ in rows]
    links = [(a, b) for a, (_, x) in enumerate(nodes) for b, (_, y) in enumerate(nodes[:a]) if 5 * len(x & y) >= 4 * len(x | y)]
    far = sum((brute_fp(rows[a][1], 5) ^ brute_fp(rows[b][1], 5)).bit_count() > 4 for a, b in links)
    assert far > 40
    root = list(range(len(nodes)))
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    least = {}
    for k, (i, _) in enumerate(nodes):
        least[root[k]] = min(least.get(root[k], i), i)
    docs = frame(spark, rows)
    assert {(r["id"], r["component"]) for r in jaccard.near_duplicates(docs).collect()} == {(i, least[root[k]]) for k, (i, _) in enumerate(nodes)}
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert jaccard.drop_near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def test_components_of_few_edges_take_few_tasks(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.sparkContext.setJobGroup("few edges", "")
        found = components(spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert {r["root"] for r in found.collect()} == {0} and found.count() == 301
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    status = spark.sparkContext.statusTracker()
    stages = {i for job in status.getJobIdsForGroup("few edges") for i in status.getJobInfo(job).stageIds}
    # the first table has a task for each partition of its shuffle; no round has
    assert 40 <= sum(x.numCompletedTasks for i in stages if (x := status.getStageInfo(i))) < 200


# Substrings


@pytest.mark.parametrize("common", [2, 600])
def test_substrings(spark, monkeypatch, common):
    monkeypatch.setattr(substrings, "COMMON", common)
    rows = corpus(3)
    got = Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.deduplicated(frame(spark, rows)).collect())
    first = {}
    for i, t, _ in rows:
        x = (t or "").encode()
        for k in range(len(x) - 49):
            w = x[k : k + 50]
            first[w] = min(first.get(w, i), i)
    want = Counter()
    for i, t, _ in rows:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - 49):
            if first[x[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for k in range(len(x)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert got == want
    assert substrings.deduplicated(frame(spark, [])).count() == 0


def test_expand_finds_windows():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 100, (40, 76)).astype(np.uint8)
    rows[20:] = rows[:20]
    rows[30:, 10] = 122
    low, high, doc = np.zeros(40, np.int64), np.full(40, 76), np.arange(40)
    got = set(zip(*(x.tolist() for x in substrings.expand(rows, low, high, doc))))
    first = {}
    for i in range(40):
        for b in range(27):
            first.setdefault(rows[i, b : b + 50].tobytes(), i)
    assert got == {(i, b) for i in range(40) for b in range(27) if first[rows[i, b : b + 50].tobytes()] < i}


def test_anchors_across_pieces(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choices("abc d", k=5000)).encode()
    whole = substrings.Texts([text], 50).anchors()
    monkeypatch.setattr(substrings, "PIECE", 700)
    parts = substrings.Texts([text], 50).anchors()
    assert whole[1].tolist() == parts[1].tolist() and whole[2].tolist() == parts[2].tolist()


# Lines


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def test_line_kernels():
    rng = random.Random(3)
    for _ in range(1500):
        a = "".join(rng.choices("abé", k=rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choices("abéx", k=rng.randint(0, 1))
        b = "".join(b)
        d = distance(a, b)
        for most in (0, 1, 2):
            assert line_dedup.edits_between(a, b, most) == min(d, most + 1)
        s, long = sorted((a, b), key=len)
        if line_dedup.allowed(len(s)) >= max(d, 1):
            assert set(line_dedup.index_entries([s])[1].tolist()) & set(line_dedup.probe_entries([long])[1].tolist())


@pytest.mark.parametrize("hot, block", [(64, 512), (0, 2), (1, 1)])
def test_lines(spark, monkeypatch, hot, block):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(6)
    lines = ["".join(rng.choices("abcd ", k=rng.randint(3, 40))) for _ in range(40)]
    for x in lines[:25]:
        y = list(x)
        for _ in range(rng.randint(1, 3)):
            y[rng.randrange(len(y))] = rng.choice("xyz")
        lines.append("".join(y))
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 6)) + ["", "  "]), "s") for i in range(40)] + [(90, None, "s"), (91, "", "s"), (None, lines[0] + "\n" + lines[41], "s"), (92, "y" * 400_000 + "\n" + "y" * 399_999, "s"), (3, lines[1], "t")]
    first, n = {}, Counter()
    order = lambda place: (place[0] is not None, place[0] or 0, place[1])  # a null id comes first
    for i, t, _ in rows:
        for k, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\v\f\r"):
                first[x] = min(first.get(x, (i, k)), (i, k), key=order)
                n[x] += 1
    root, links = {x: x for x in first}, Counter()
    long = ["y" * 400_000, "y" * 399_999]
    pairs = [(a, b) for a in first for b in first if order(first[a]) < order(first[b]) and (a in long and b in long or max(len(a), len(b)) < 1000 and distance(a, b) <= line_dedup.allowed(min(len(a), len(b))))]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in range(len(first)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b], key=lambda x: order(first[x]))
    assert pairs
    got = {tuple(r) for r in line_dedup.classes(frame(spark, rows)).collect()}
    assert got == {(*first[x], n[x], *first[root[x]], links[x]) for x in first}
    cut = line_dedup.deduplicated(frame(spark, rows)).collect()
    assert sum(r["n_removed"] for r in cut) == sum(n.values()) - len(set(root.values()))
    cut = {r["id"]: r for r in cut}
    assert cut[90]["text"] == "" and line_dedup.classes(frame(spark, [])).count() == 0


# Decontamination


def test_decontamination(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefgéßжü", k=rng.randint(2, 8))) for _ in range(300)]
    say = lambda k: rng.choices(vocab, k=k)
    cut = lambda n: " ".join(say(n))[:n].strip().ljust(n, "z")
    items = [(i, " ".join(say(rng.randint(8, 60)))) for i in range(14)] + [(14 + k, cut(n)) for k, n in enumerate((24, 29, 30, 31, 32, 39))] + [(97, "y" * 340_000), (98, "too short"), (99, None), (None, "another item that has no number of its own")]
    rows, want = [], set()
    for d in range(80):
        t = say(rng.randint(5, 120))
        if d % 4 == 0 or d > 60:
            i, x = items[rng.randrange(20) if d % 2 else 14 + d // 4 % 6]
            w = list(x)
            for _ in range(rng.choice((0, 1, len(w) // 10, len(w) // 10 + 1))):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choices("qжü", k=rng.randint(0, 1))
            at = rng.randint(0, len(t))
            t[at:at] = [("".join(w)).upper() if d % 8 else "".join(w) + ","]
        rows.append((d, "  ".join(t), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "x " * 600_000 + items[0][1], "s"), (0, rows[0][1], "s"), (None, rows[4][1], "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = lambda t: re.sub("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", (t or "").lower()).strip(" ")
    for d, t, _ in rows:
        text = plain(t)
        for i, x in items[:20]:
            item = plain(x)
            p = [0] * (len(text) + 1)
            if d == 502:
                p = [0 if item in text else 99]
            else:
                for c in item:
                    q = [p[0] + 1]
                    for j, y in enumerate(text):
                        q.append(min(p[j] + (c != y), p[j + 1] + 1, q[j] + 1))
                    p = q
            if min(p) <= len(item) // 10:
                want.add((d, i, min(p)))
    found = decontaminate.contaminated(frame(spark, rows), bench).collect()
    assert {(r["id"], r["item"], r["edits"]) for r in found} == want and any(e for *_, e in want) and any(i > 13 and e == 3 for _, i, e in want)
    assert len([r for r in found if r["id"] == 0]) == 2 * len([w for w in want if w[0] == 0])
    kept = decontaminate.decontaminated(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    gone = {w[0] for w in want} - {None}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, *_ in rows if d not in gone), key=str)
    assert decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0


def test_short_benchmark_items(spark):
    items = [(1, "What is love?"), (2, "Yes."), (3, "photosynthesis"), (4, "?!"), (5, "what is LOVE")]
    rows = [(0, "So, what  is love - what is love, I ask", "s"), (1, "somewhat is love", "s"), (2, "YES!", "s"), (3, "yes and no", "s"), (4, "photosynthesis", "s"), (5, "a photosynthesis-like act", "s"), (6, "photosynthesiss", "s"), (7, "", "s"), (8, None, "s"), (9, "what is lov", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contaminated(frame(spark, rows), bench).collect()))
    assert got == [(0, 1, 3, 0), (0, 5, 3, 0), (2, 2, 0, 0), (4, 3, 0, 0), (5, 3, 2, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(frame(spark, rows), bench).collect()) == [1, 3, 6, 7, 8, 9]


def test_benchmark_in_blocks(spark, monkeypatch, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = decontaminate.contaminated(docs, bench)
    want = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == want and want


# Mixing


def target_of(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark):
    rows = corpus(8, 300)
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORDS.findall((t or "").encode()))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    target, total = target_of(sizes), sum(sizes.values())
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * total
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(size(t) for _, t, x in rows if x == s) + 1
    again = mixing.mix(frame(spark, rows[::-1]).repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mixed(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).count() == 0


# Token ids


def test_token_ids_of_plain_texts_among_others():
    made = token_ids.Encoder(token_ids.default_tokenizer(), keep=50)
    rng = random.Random(8)
    words = ["a", "of", "ofenaning.", "Edin***", "\u00e9tre", "\u4f60\u597d", "x1y2", "don't", "7", ".", "\U0001f600", "onder###", "A.,"]
    plain = ["\n".join(" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    odd = ["", " ", "a  b", "a\0b of", "\0", "a\tb of", " of", "of ", "a\n\nb", "</s> of", "<|endoftext|>", "a\u00a0b of"]
    mixed = plain + odd + plain[:20]
    rng.shuffle(mixed)
    want = [made._ids([x])[0] for x in mixed]
    assert made.encode(mixed) == want and made.encode(mixed) == want and made.encode([]) == []
    assert list(made._ids_of_plain(plain)) == [made._ids([x])[0] for x in plain] and list(made._ids_of_plain([])) == []


@pytest.mark.parametrize("bits", [False, True])
def test_token_ids(spark, bits):
    from tokenizers import Tokenizer

    rows = corpus(9)
    tok = Tokenizer.from_file(token_ids.default_tokenizer())
    rows += [(100, "a<|endoftext|> b <|endoftext|>.\nc", "s"), (None, "null id", "s")]
    at, want = 0, Counter()
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want[i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    got = token_ids.round_trip(frame(spark, rows), block=100, chunk=5000, bits=bits).collect()
    assert Counter(map(tuple, got)) == want
    assert token_ids.round_trip(frame(spark, [])).count() == 0


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, texts = Tokenizer.from_file(path), ["Two  words.", "", "a\nb", "<|endoftext|> x"]
    got = token_ids.Encoder(path).encode(texts)
    assert got == [np.array(tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_planes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4") if n != 8 else np.zeros(8, "<u4")
        for bits in (False, True):
            sizes, payload = token_ids.pack(ids, 64, bits)
            assert (token_ids.unpack(n, 64, bits, sizes, payload) == ids).all()


def test_words_are_encoded_as_one_text():
    """Words not seen before reach the tokenizer together; parts with other white space or marks keep their own ids."""
    enc = token_ids.Encoder(token_ids.default_tokenizer())
    whole, ask = enc._ids, []
    enc._ids = lambda parts: ask.extend(parts) or whole(parts)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdxyzéß漢😀'19_-", k=rng.randint(1, 9)))
    words = [word() for _ in range(9_000)]
    texts = [" ".join(words), "x" + "".join(rng.choice((" ", "  ", "\n", " \n", "\t", "\u00a0", "\u3000")) + w for w in words[:500]), "", " ", " a", "a ", " a\tb c", "\u0120 \u0120a"]
    assert enc.encode(texts) == whole(texts)
    assert len(ask) < 1_500
    assert list(token_ids.slices(pa.array(["ab", None, "c" * 90, "", "d"]), 5)) == [(0, 2), (2, 3), (3, 5)]
    assert list(token_ids.slices(pa.array([], pa.string()))) == []


def test_encoder_parts():
    rng = random.Random(5)
    enc = token_ids.Encoder(token_ids.default_tokenizer(), keep=60)
    parts = ["a", "b ", "  ", "\n", "word", " word", "é", "1 2", "'s", " 'll", "\t", "日本", "x", "!!", " ", "\x1c", "\x85", ".", ",\n", "the, ", "The.", " ½", "²", "\xa0", "\0"]
    for _ in range(300):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3)]
        for x, got in zip(texts, enc.encode(texts)):
            assert got == np.array(enc.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


# Token counts


def test_count_tree():
    rng = random.Random(1)
    count = token_counts.counter(token_counts.default_ranks())
    parts = ["a", "b ", "  ", "\n", "word", " word", "é", "1 2", "'s", "\t", "日本", "!!", " ", "\x85"]
    for _ in range(600):
        s = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        tree = token_counts.Tree(s, count, leaf=rng.choice([1, 2, 4]))
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, len(s))
            b = rng.randint(a, min(len(s), a + rng.choice([0, 1, 5, 30])))
            new = "".join(rng.choices(parts, k=rng.randint(0, 3)))
            tree.edit(a, b, new)
            s = s[:a] + new + s[b:]
            assert (tree.text, tree.n_tokens, tree.n_chars) == (s, len(count.encode(s)), len(s))


def test_counts_follow_edits(spark, tmp_path):
    rows = [(1, "mail a.b@c.org now, or call +49 (30) 1234567 at once", "s"), (2, None, "s"), (3, "", "s"), (4, "none", "s"), (5, "x " * 50_000 + "a@b.cc", "s"), (None, "no id a@b.cc", "s"), (4, "none", "s")]
    docs = frame(spark, rows)
    count = token_counts.counter(token_counts.default_ranks())
    size = lambda t: len(count.encode(t))
    token_counts.trees(docs).write.parquet(str(tmp_path / "one"))
    kept = spark.read.parquet(str(tmp_path / "one"))
    first = token_counts.edited(kept, token_counts.scrub(token_counts.text_of()))
    first.write.parquet(str(tmp_path / "two"))
    first = spark.read.parquet(str(tmp_path / "two"))
    got = Counter(map(tuple, token_counts.counted(first).select("id", "n_tokens", "n_edits", "tokens_after", "chars_after").collect()))
    after = [(i, t or "", *re.subn(token_counts.SCRUB, "<private>", t or "")) for i, t, _ in rows]
    assert got == Counter((i, size(t), n, size(x), len(x)) for i, t, x, n in after)
    assert {r["id"]: r["encoded_again"] for r in first.collect()}[5] < 1000
    # a second round over the trees as they were kept: only what it touches is encoded
    edits = spark.createDataFrame([(4, 0, 2, "so"), (4, 3, 4, ""), (None, 0, 2, "one"), (5, 10, 12, "yes "), (5, 99_990, 99_992, None)], "id long, start long, end long, text string")
    second = token_counts.edited(token_counts.with_edits(first, edits), F.col("edits"))
    now = {r["id"]: (token_counts.Tree.kept(r["leaves"], r["chars"], r["tokens"], count).text, r["tokens"][1], r["encoded_again"]) for r in second.collect()}
    long = next(x for i, _, x, _ in after if i == 5)
    long = long[:10] + "yes " + long[12:99_990] + long[99_992:]
    assert now[5][:2] == (long, size(long)) and now[5][2] < 1000
    assert now[4][:2] == ("son", size("son")) and now[None][0] == "one id <private>" and now[1][2] == 0
    with pytest.raises(ValueError, match="column edits"):
        token_counts.with_edits(kept.withColumn("edits", F.lit(1)), edits)
    assert token_counts.counted(token_counts.edited(token_counts.trees(frame(spark, [])), F.lit(None).cast("array<struct<start:long,end:long,text:string>>"))).count() == 0


# Chat


def test_template_is_reversible():
    rng = random.Random(2)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "[TURN ", "]", "[OUT]", "[SYS]", " ", "\n", "x", "[/TURN]", "[/SYS]", "["]
    for _ in range(4000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "a]b\\"]), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(x for r, x in turns if r == "assistant")


def test_layouts(spark):
    import json

    records = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 5}, [("user", "a"), ("assistant", "b")]),
        ({"prompt": "a", "completion": "b", "meta": {"x": [1]}}, [("user", "a"), ("assistant", "b")]),
        ({"instruction": "a", "input": "", "output": "b"}, [("user", "a"), ("assistant", "b")]),
        ({"instruction": "a", "input": "c", "output": "b"}, [("user", "a"), ("user", "c"), ("assistant", "b")]),
        ({"data": {"prompt": "a", "response": "b"}}, [("user", "a"), ("assistant", "b")]),
        ({"messages": []}, []),
        ({"other": 1}, None),
        ([1], None),
        ({"messages": ["a", "b"]}, None),
        ({"prompt": "a\ud800", "response": "\ud83d\ude00"}, [("user", "a\ufffd"), ("assistant", "\U0001f600")]),
        ({"prompt": {"x": [1]}, "response": 5}, None),
    ]
    deep = '{"prompt": ' + "[" * 100_000 + "]" * 100_000 + ', "response": "b"}'
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(records)] + [(97, deep), (98, "{"), (99, None), (None, None)]
    odd = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, record string, id string, loss string")
    got = {r["id"]: r["formatted"] for r in chat.format_records(odd).collect()}
    assert [got[i] and chat.parse(got[i]) if got[i] is not None else None for i in range(len(records))] == [t for _, t in records]
    assert got[97] is None and got[98] is None and got[99] is None
    assert chat.format_records(odd.limit(0)).count() == 0 and chat.records(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_conversations_round_trip(spark):
    rng = random.Random(4)
    rows = [(c, k, rng.choice(["user", "assistant"]) if c % 4 else "tool", rng.choice(["hi", None, "", "[INST] x </s>", "ü" * 3000])) for c in range(40) for k in range(rng.randint(1, 5))] + [(5, 0, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["id"]: r for r in chat.digests(chat.format_records(chat.records(df), "id")).collect()}
    by = {}
    for c, k, r, t in sorted(rows, key=lambda x: (x[0], x[1], x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((r or "", t or ""))
    for c, turns in by.items():
        ours = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(ours), hashlib.sha256(ours.encode()).hexdigest())


# HTML


def test_main_text(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["id"]: r["text"] for r in html_extract.main_texts(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [re.sub(r"</?(?:b|i|em|a|strong)\b[^>]*>", "", re.sub(r"<br>", " ", x)) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n".join(y for x in parts if (y := " ".join(html.unescape(x).split())))


def test_odd_pages(spark, sf):
    model = html_extract.train(spark.read.parquet(f"{sf}/pages.parquet"))
    text = lambda x: html_extract.main_text(x, model)
    assert text("") == "" and text("<") in ("", "<")
    page = '<body><header>Site</header><div id="cookie-notice">We use cookies</div><div class="content"><h1>Title &amp; more words</h1><p>Some long text here, with <a href="x">link</a> and more.<p>Second para. It has words, too.<ul><li>one thing<li>two things</ul><aside>side</aside><form>f<input></form><div class="comments"><p>Nice post, thanks.</p></div></div><div class="sidebar">Foo</div><footer>F</footer>'
    assert text(page).split("\n") == ["Title & more words", "Some long text here, with link and more.", "Second para. It has words, too.", "one thing", "two things"]
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<div>" * 3000 + "x"), (3, "u", "<p>")]
    rows += [(None, "u", page), (5, "u", page.replace("Some long", "word " * 100_000))]
    odd = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, id string, text string")
    got = html_extract.extract(odd, model).collect()
    assert len(got) == 6 and all(r["text"] is not None for r in got)
    assert [len(r["text"].split()) > 100_000 for r in got if r["id"] == 5] == [True]
    assert html_extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hostile_pages_take_linear_time():
    import time

    parts = ["<a href=\"x", "<a 'x", "</script", "<script>", "<!--", "<![CDATA[", "</x>", "<p>", "<b><i>", "<td>", "\"", "<div class='"]
    for x in parts:
        began = time.process_time()
        html_extract.Page(x * 60_000)
        assert time.process_time() - began < 20, x
    page = html_extract.Page("<p>a <b title='x > y'>b</b> 3 < 4 <i title=\"z>c</i></p><script>if (a<b) '</p>'</script >d<!-- <p>x --> e<![CDATA[<f>]]>")
    assert "".join(page.said).split() == ["a", "b", "3", "<", "4", "cd", "e<f>"]


def test_decode_has_no_contradictions():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = 9
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        score = rng.normal(size=n)
        best = max(((sum(score[i] for i in range(n) if k >> i & 1), k) for k in range(1 << n) if all(not k >> i & 1 or i == 0 or k >> parent[i] & 1 for i in range(n))), default=None)
        kept = html_extract.decode(parent, score)
        assert all(not kept[i] or i == 0 or kept[parent[i]] for i in range(n))
        assert abs(sum(score[i] for i in range(n) if kept[i]) - best[0]) < 1e-9


# Quality


def brute_counts(text):
    raw = (text or "").encode()
    w = WORDS.findall(raw)
    threes = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def brute_probability(text, model):
    """The model's probability by plain arithmetic over the text's grams, words and word pairs."""
    mask, shift, score = (1 << 32) - 1, 32 - quality.BITS, model.intercept
    b = (text or "").encode()
    chars = [(int.from_bytes(b[i : i + 4], "little") * 0x9E3779B1 & mask) >> shift for i in range(len(b) - 3)]
    hashes = []
    for w in WORDS.findall(b):
        h = sum((c + 1) * 2654435761 & mask ^ 0x5BD1E995 for c in w) & mask
        for k in range(3):
            h = (h * 31 + (w[k] if k < len(w) else 0)) & mask
            h = (h * 37 + (w[-1 - k] if k < len(w) else 0)) & mask
        hashes.append(h * 0x85EBCA6B & mask)
    pairs = [(x ^ y >> 7) * 0xC2B2AE35 & mask for x, y in zip(hashes, hashes[1:])]
    words = [quality.FEATURES + (h >> shift) for h in hashes + pairs]
    for grams in (chars, words):
        if grams:
            score += quality.SCALE * sum(float(model.weights[g]) for g in grams) / len(grams)
    return 1 / (1 + np.exp(-np.clip(model.slope * score + model.offset, -40, 40)))


def test_quality_verdict(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").unionByName(frame(spark, corpus(13)).select((F.col("doc_id") + 10_000).alias("doc_id"), "text")).collect()
    model = quality.train(docs, labels.unionByName(labels.limit(5)))
    got = {(r["doc_id"], r["text"]): r["judged"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        c, p = brute_counts(t), brute_probability(t, model)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        g = got[i, t]
        assert g["base_failed"] == failed and abs(g["probability"] - p) < 1e-4
        assert g["kept"] == (not failed and p >= quality.KEEP_FROM) or abs(p - quality.KEEP_FROM) < 1e-4
    assert {g["kept"] for g in got.values()} == {True, False}


def test_repeated_and_conflicting_labels(spark):
    docs = frame(spark, corpus(11)).select("doc_id", "text")
    labels = [(i, int(i % 2), None) for i in range(40)] + [(i, 0, None) for i in range(0, 40, 4)] + [(7, None, None), (None, 1, None)]
    one = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    two = quality.train(docs, spark.createDataFrame(labels[::-1] * 2, "doc_id long, quality int, toxic int"))
    assert np.allclose(one.weights, two.weights, atol=1e-3) and abs(one.intercept - two.intercept) < 1e-3
    high = [(i, 1, None) for i in range(40)] + [(i, 0, None) for i in range(40)]
    assert quality.train(docs, spark.createDataFrame(high, "doc_id long, quality int, toxic int")) is None  # the lower label counts, so one class is left


def test_quality(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["id"]: r for r in quality.assess(docs, labels).collect()}
    for r in docs.collect():
        c = brute_counts(r["text"])
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == c
        assert g["base_failed"] == (c[0] < 50 or 100 * c[4] > 50 * c[0])


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(4)) == 0
    model = quality.train(docs, labels.where(~held))
    rows = quality.judge(docs.join(labels.where(held), "doc_id"), model).select("quality", "judged.*").collect()
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    assert np.mean([r["probability"] >= quality.KEEP_FROM for r in good]) > 0.97
    assert np.mean([not r["kept"] for r in bad]) > 0.8


def test_quality_odd_tables(spark):
    rows = corpus(11)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows).withColumn("judged", F.lit(1))
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns
    want = [t for _, t, _ in rows if (c := brute_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    assert Counter(r["text"] for r in kept.collect()) == Counter(want)
    assert quality.assess(docs.limit(0), none).count() == 0


def test_decontamination_of_repetitive_text_is_bounded(monkeypatch):
    """A long text of one repeated word against an item of its repeats: every gram meets every repeat."""
    import tracemalloc

    index = decontaminate.Index([(7, decontaminate.normal("lorem " * 200))])
    text = decontaminate.normal("ipsum " + "lorem " * 25_000)
    tracemalloc.start()
    got = decontaminate.search(index, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(d, i, e) for d, i, _, e in got] == [(0, 0, 0)] and peak < 300e6
    some = [decontaminate.normal(x) for x in ("a b c d e f g h " * 40, "lorem " * 230, "nothing of it", "x " + "lorem " * 190 + "y")]
    want = decontaminate.search(index, some)
    monkeypatch.setattr(decontaminate, "HITS", 50)
    assert decontaminate.search(index, some) == want and {d for d, *_ in want} == {1, 3}


SOME = [" word", "  ", "\n", "\n\n", "don't", "'ll", " 123", "\u65e5\u672c", "\u3002", "\u00e9", "\t", "ab", "X", "-", "\u2026", " ", "'"]


def test_edits_anywhere_in_texts_of_any_kind():
    count, rng = token_counts.Counter(token_counts.default_ranks()), random.Random(1)
    mixed = lambda n: "".join(rng.choices(SOME, k=n))
    for _ in range(60):
        text = mixed(rng.randint(1, 160))
        tree = token_counts.Tree(text, count)
        for _ in range(12):
            assert (tree.n_tokens, tree.n_chars) == (len(count.encode(text)), len(text))
            at = rng.randrange(len(text) + 1)
            end, new = min(len(text), at + rng.choice([0, 1, 3, 30])), mixed(rng.randint(0, 2))
            text = text[:at] + new + text[end:]
            tree.edit(at, end, new)
            assert tree.text == text and tree.n_tokens == len(count.encode(text)), (text, at, new)


@pytest.mark.parametrize("kind", ["lines", "tabs", "han"])
def test_edits_encode_little_again_without_lone_spaces(kind):
    count, rng = token_counts.Counter(token_counts.default_ranks()), random.Random(2)
    text = {"lines": "\n".join(f"line{k}" for k in range(12_000)), "tabs": "\t".join(f"c{k}" for k in range(15_000)), "han": "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(100_000))}[kind]
    tree = token_counts.Tree(text, count)
    for _ in range(20):
        at = rng.randrange(len(text))
        text = text[:at] + "new\n" + text[at + 2 :]
        tree.edit(at, min(tree.n_chars, at + 2), "new\n")
    assert tree.text == text and tree.n_tokens == len(count.encode(text))
    assert tree.encoded < 20 * 1000 and max(map(len, tree.leaves)) < 2000
