"""Preparation of token rows and evaluation prompts for language models."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip


def pack(df: DataFrame, capacity: int, buffer: int = 1000, pad: int | None = None, key: str = "id", tokens: str = "tokens", mask: str | None = None, marker: int | None = None, shards: int | None = None, shard_tokens: int = 1 << 20) -> DataFrame:
    """(shard, row, tokens, targets, parts): rows of exactly `capacity` tokens from tokenized documents, by best fit: the
    longest buffered document that fits goes next, the first of equals. When none fits, the shortest is cropped to fill
    the row (pad None), or the row is filled up with `pad` and nothing is lost; with pad, documents over the capacity come
    as rows of their own, uncut, with row -1. A shard's last row that can't be filled is dropped when cropping.

    targets are the tokens that follow, -1 where `mask` is 0 and on padding. A marker is put before each document, so that
    every row begins with one. Shards are packed on their own, each with `buffer` documents in memory, in the order of
    key; df's column shard names them, or the key's hash makes `shards` of them, by default one for each shard_tokens tokens,
    so their size doesn't grow with the corpus and files and partitions decide nothing.
    """
    if shards is None and "shard" not in df.columns:
        shards = max(1, -(-(df.agg(F.sum(F.size(tokens))).first()[0] or 0) // shard_tokens))
    shard = F.col("shard") if "shard" in df.columns else F.pmod(F.xxhash64(key), F.lit(shards))
    kept = F.col(mask) if mask else F.transform(tokens, lambda x: F.lit(1))
    rows = df.select(shard.cast("int").alias("shard"), F.col(key).alias("id"), F.col(tokens).alias("tokens"), kept.alias("mask"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "id", "tokens")
    lead = [] if marker is None else [marker]
    names = ["shard", "row", "tokens", "targets", "parts"]

    def made(shard: int, n: int, row: list[int], wanted: list[int], parts: int) -> tuple:
        return shard, n, row, [t if m else -1 for t, m in zip(row[1:], wanted[1:])], parts

    def packed(shard: int, source: Iterator[tuple[list[int], list[int]]]) -> Iterator[tuple]:
        held: list[tuple[int, int, list[int], list[int]]] = []  # (size, -arrival, tokens, mask), by size
        arrived = n = 0

        def refill() -> Iterator[tuple]:
            nonlocal arrived
            while len(held) < buffer and (item := next(source, None)) is not None:
                if pad is not None and len(item[0]) > capacity:
                    yield made(shard, -1, *item, 1)
                elif item[0]:
                    insort(held, (len(item[0]), -arrived, *item), key=lambda x: x[:2])
                    arrived += 1

        yield from refill()
        while held:
            row, wanted, parts = [], [], 0
            while len(row) < capacity and held:
                at = bisect_right(held, (capacity - len(row), 1), key=lambda x: x[:2])
                if not at and pad is not None:
                    break
                _, _, t, m = held.pop(at - 1 if at else 0)
                space = capacity - len(row)
                row, wanted, parts = row + t[:space], wanted + m[:space], parts + 1
                yield from refill()
            if len(row) < capacity:
                if pad is None:
                    return
                row, wanted = row + [pad] * (capacity - len(row)), wanted + [0] * (capacity - len(wanted))
            yield made(shard, n, row, wanted, parts)
            n += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = ((int(s), lead + list(t), [0] * len(lead) + list(m)) for b in batches for s, t, m in zip(b["shard"], b["tokens"], b["mask"]) if len(t))
        rows = (r for s, group in groupby(items, key=lambda x: x[0]) for r in packed(s, ((t, m) for _, t, m in group)))
        while out := list(islice(rows, 256)):
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, "shard int, row int, tokens array<int>, targets array<int>, parts int")


def _shots(shots: Column, one) -> Column:
    """Rendered examples, a blank line after each."""
    return F.array_join(F.transform(shots, lambda e: F.concat(one(e), F.lit("\n\n"))), "")


def render_choices_eval(query: Column, choices: Column, shots: Column, delimiter: str = "\n") -> Column:
    """A prompt for each choice: the shots (array<struct<query, choices, gold>>), the query, the delimiter, the choice."""
    prefix = _shots(shots, lambda e: F.concat(e["query"], F.lit(delimiter), F.get(e["choices"], e["gold"])))
    return F.transform(choices, lambda o: F.concat(prefix, query, F.lit(delimiter), o))


def render_schema_eval(contexts: Column, continuation: Column, shots: Column, delimiter: str = "\n") -> Column:
    """A prompt for each context: the shots (array<struct<context_options, continuation, gold>>), the context, the
    delimiter, the continuation."""
    prefix = _shots(shots, lambda e: F.concat(F.get(e["context_options"], e["gold"]), F.lit(delimiter), e["continuation"]))
    return F.transform(contexts, lambda c: F.concat(prefix, c, F.lit(delimiter), continuation))


def render_language_eval(context: Column, continuation: Column, shots: Column, delimiter: str = "\n") -> Column:
    """Two prompts, without and with the continuation, contexts trimmed: the shots (array<struct<context, continuation>>),
    the context, the delimiter; the first is stripped, so that its tokens begin the second's."""
    prefix = _shots(shots, lambda e: F.concat(strip(e["context"]), F.lit(delimiter), e["continuation"]))
    start = F.concat(prefix, strip(context), F.lit(delimiter))
    return F.array(strip(start), F.concat(start, continuation))


def common_prefix(options: Column) -> Column:
    """How many leading items all arrays of an array share."""
    first = options[0]
    n = F.array_min(F.transform(options, lambda o: F.size(o)))
    same = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.forall(options, lambda o: F.get(o, i) == F.get(first, i)))
    misses = F.array_position(same, F.lit(False))
    return F.when(n == 0, 0).otherwise(F.when(misses == 0, n).otherwise((misses - 1).cast("int")))


def common_suffix(options: Column) -> Column:
    """How many trailing items all arrays of an array share."""
    return let(F.transform(options, F.reverse), common_prefix)


def answer_spans(options: Column, kind: str, most: int | None = None) -> Column:
    """array<struct<tokens, start, end>> of an item's prompts as token arrays. "choices": what follows the common prefix;
    "schema": the common suffix; "language": of two prompts the second, from where the first ends. Tokens over `most` go
    from the left, and the span moves with them."""
    if kind == "language":
        spans = F.array(F.struct(options[1].alias("tokens"), F.size(options[0]).alias("start")))
    elif kind == "choices":
        spans = let(options, lambda x: let(common_prefix(x), lambda n: F.transform(x, lambda o: F.struct(o.alias("tokens"), n.alias("start")))))
    elif kind == "schema":
        spans = let(options, lambda x: let(common_suffix(x), lambda n: F.transform(x, lambda o: F.struct(o.alias("tokens"), (F.size(o) - n).alias("start")))))
    else:
        raise ValueError(f"unknown kind {kind}")
    cut = lambda s: left_truncate(s["tokens"], s["start"], most) if most is not None else s
    return F.transform(F.transform(spans, cut), lambda s: F.struct(s["tokens"].alias("tokens"), s["start"].alias("start"), F.size(s["tokens"]).alias("end")))


def left_truncate(tokens: Column, start: Column, most: int) -> Column:
    """The last `most` items, and where a span that began at start begins now: struct<tokens, start>."""
    cut = F.greatest(F.size(tokens) - most, F.lit(0))
    return F.struct(F.slice(tokens, cut + 1, F.lit(most)).alias("tokens"), F.greatest(start - cut, F.lit(0)).alias("start"))


def _pick(key: str, seed: int, name: Column | str, n: Column) -> Column:
    """A number below n, by the first digits of a hash of seed, name and row."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), name, F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), n).cast("int")


#: Questions on a word's letter, of which each example takes one.
TEMPLATES = [("How many ", " are in ", "?"), ("Count the letter ", " in ", "."), ("In how many places does ", " stand in ", "?")]


def spelling_examples(words: DataFrame, ids: DataFrame, split: str = "train", seed: int = 42) -> DataFrame:
    """words(rank, word), ranks from 0, and ids(id) -> a synthetic conversation for each id that asks for a letter's count
    in a word; train and test draw from different seeds."""
    s = seed + (1 if split == "test" else 0)
    size = words.agg(F.count("*").alias("size"))
    rows = ids.select("id").crossJoin(size).withColumn("rank", _pick("id", s, "word", F.col("size")).cast("long")).join(words, "rank")  # size is one row
    letter = F.substring("word", _pick("id", s, "letter", F.length("word")) + 1, F.lit(1))
    rows = rows.withColumn("letter", letter).withColumn("t", _pick("id", s, "template", F.lit(len(TEMPLATES))))
    count = F.length("word") - F.length(F.replace("word", F.col("letter"), F.lit("")))
    texts = F.array(*[F.concat(F.lit(a), "letter", F.lit(b), "word", F.lit(c)) for a, b, c in TEMPLATES])
    return rows.select("id", "word", "letter", count.alias("n"), F.get(texts, F.col("t")).alias("question"), F.concat(F.lit("#### "), count.cast("string")).alias("answer"))


def diversity_sample(df: DataFrame, key: str, topics: dict[str, list[str]], dimensions: dict[str, list[str]], openers: dict[str, list[str]], seed: int = 42) -> DataFrame:
    """df's rows, by key, with a category and a topic of it, a value of each other dimension, and opener lines: one of each
    of three categories. All by hash, so a row's sample doesn't depend on the others."""
    text = lambda values: F.array(*map(F.lit, values))
    one = lambda name, values: F.get(text(values), _pick(key, seed, name, F.lit(len(values))))
    pairs = lambda d: F.array(*[F.struct(F.lit(k).alias("k"), text(v).alias("v")) for k, v in d.items()])
    topic = F.get(pairs(topics), _pick(key, seed, "category", F.lit(len(topics))))
    rows = df.select(key).withColumn("t", topic)
    order = F.sort_array(F.transform(pairs(openers), lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), x["k"], F.col(key).cast("string"))).alias("h"), x["k"].alias("k"), x["v"].alias("v"))))
    lines = F.transform(F.slice(order, 1, 3), lambda x: F.concat(F.lit("- "), F.get(x["v"], _pick(key, seed, x["k"], F.size(x["v"])))))
    return rows.select(key, F.col("t.k").alias("category"), F.get(F.col("t.v"), _pick(key, seed, "topic", F.size("t.v"))).alias("topic"), *[one(k, v).alias(k) for k, v in dimensions.items()], F.array_join(lines, "\n").alias("openers"))
