"""Conversations as tables of turns: validation, flattening with loss masks, and priming for completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_PARTS = "array<struct<type:string,text:string>>"


def as_arrays(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as array<struct<turn, role, text, parts>>; parts, if turns has
    them, are the pieces of an answer that calls tools, as tool_calls() gives them."""
    parts = F.col("parts") if "parts" in turns.columns else F.lit(None)
    t = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"), parts.cast(_PARTS).alias("parts"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).alias("turns"))


def validate(turns: DataFrame) -> DataFrame:
    """(conv_id, n, verdict) of each conversation: ok, blank (an empty text), short (under two messages besides a
    leading system one) or order (user and assistant don't alternate from user)."""
    led = F.col("turns")[0]["role"] == "system"
    rest = F.when(led, F.slice("turns", 2, 1 << 30)).otherwise(F.col("turns"))
    right = F.forall(F.transform(rest, lambda x, i: x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
    verdict = F.when(F.exists("turns", lambda x: F.trim(x["text"]) == ""), "blank").when(F.size(rest) < 2, "short").when(~right, "order").otherwise("ok")
    return as_arrays(turns).select("conv_id", F.size("turns").cast("long").alias("n"), verdict.alias("verdict"))


def flatten(turns: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """(conv_id, tokens, mask): words as tokens with a marker before and after each turn; a leading system text joins
    the first user text; cut at max_tokens. The mask is 1 on what the assistant says, its tool calls with their markers,
    and its end marker; 0 on all else, the tools' output with its markers included."""
    a = as_arrays(turns)
    led = (F.col("turns")[0]["role"] == "system") & (F.size("turns") > 1)
    second = F.col("turns")[1]
    merged = F.struct(second["turn"].alias("turn"), second["role"].alias("role"), F.concat(F.col("turns")[0]["text"], F.lit("\n\n"), second["text"]).alias("text"), second["parts"].alias("parts"))
    a = a.withColumn("turns", F.when(led, F.concat(F.array(merged), F.slice("turns", 3, 1 << 30))).otherwise(F.col("turns")))
    said = lambda text, m: F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.struct(w.alias("t"), F.lit(m).alias("m")))
    mark = lambda name, m: F.array(F.struct(name.alias("t"), F.lit(m).alias("m")))
    framed = lambda text, name, m: F.concat(mark(F.lit(f"<|{name}_start|>"), m), said(text, m), mark(F.lit(f"<|{name}_end|>"), m))

    def piece(p):
        kind, text = p["type"], F.coalesce(p["text"], F.lit(""))
        unknown = F.raise_error(F.concat(F.lit("unknown part type: "), kind)).cast("array<struct<t:string,m:int>>")
        return F.when(kind == "text", said(text, 1)).when(kind == "python", framed(text, "python", 1)).when(kind == "python_output", framed(text, "output", 0)).otherwise(unknown)

    def turn(x):
        start, end = (F.concat(F.lit("<|"), x["role"], F.lit(f"_{e}|>")) for e in ("start", "end"))
        ours = F.when(x["parts"].isNotNull(), F.flatten(F.transform(x["parts"], piece))).otherwise(said(x["text"], 1))
        return F.when(x["role"] == "assistant", F.concat(mark(start, 0), ours, mark(end, 1))).otherwise(F.concat(mark(start, 0), said(x["text"], 0), mark(end, 0)))

    every = F.slice(F.concat(mark(F.lit("<|bos|>"), 0), F.flatten(F.transform("turns", turn))), 1, max_tokens)
    return a.select("conv_id", every.alias("e")).select("conv_id", F.transform("e", lambda x: x["t"]).alias("tokens"), F.transform("e", lambda x: x["m"]).alias("mask"))


def for_completion(turns: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """(conv_id, tokens): conversations that end with an assistant turn, without it and with its start marker."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    last = turns.withColumn("last", F.max("turn").over(w)).withColumn("last_role", F.max_by("role", "turn").over(w))
    kept = last.where("last_role = 'assistant' and turn < last").select(turns.columns)
    return flatten(kept, max_tokens - 1).select("conv_id", F.concat("tokens", F.array(F.lit("<|assistant_start|>"))).alias("tokens"))


def shift_targets(flat: DataFrame) -> DataFrame:
    """(conv_id, inputs, targets): tokens moved by one; targets that the mask leaves out are null."""
    n = F.size("tokens")
    targets = F.zip_with(F.slice("tokens", F.lit(2), n), F.slice("mask", F.lit(2), n), lambda t, m: F.when(m == 1, t))
    return flat.where(n > 1).select("conv_id", F.slice("tokens", F.lit(1), n - 1).alias("inputs"), targets.alias("targets"))
