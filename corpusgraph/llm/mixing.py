"""Operator 9: mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source the documents are ordered by size, so that the sample is spread over all sizes. Each document's expected
copies are summed up in that order, one random offset is added, and a document is taken once for each whole number that
its own share of the sum passes. The sums are built in two levels, so that a hot source or a group of equally long
documents is never one task: counts by (source, size, slot) first, then the rows of one slot.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Weights of the sources in order, repeating, and the most copies of a source.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes(source, source_size) -> with target: all sizes shared out by weight, none over `most` times its source's
    size, what is above shared anew by weight among the rest.

    Only sources are rows here. The stopped sources are a prefix in the order of size per weight, so one pass finds
    them: with the first k stopped, the rest get (total - their caps) / (remaining weight) for each unit of weight.
    """
    everyone = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")))
    cap = F.lit(most) * F.col("source_size")
    by_cap = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("level", level)
    final = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everyone)  # the first that no later source stops
    share = F.coalesce(final, F.col("ratio")) * F.col("weight")
    return levels.withColumn("target", F.least(F.col("cap"), share)).select("source", "source_size", "weight", "target")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, h): words of each document, and a hash that tells rows of one id apart."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(text_col)).alias("h"))


def copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 42) -> DataFrame:
    """rows(id, source, size, h) -> with source_size, target and copies, one row for each.

    Copies are `most` at most. Empty documents get copies like any other of their source, but no words. Equal rows may
    get different copies; as a set the result is the same in each run.
    """
    rows = stored(rows, "sizes")
    groups = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "groups")
    sums = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    aims = stored(targets(sums.select("source", "source_size"), weights, most).join(sums.select(F.col("source").alias("s2"), "docs"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "targets")
    # slots so that neither a slot's rows nor a source's slots grow faster than the root of the row count
    slot_rows = max(64, math.isqrt(rows.count()) // 2)
    slots = groups.select(F.col("source").alias("s3"), F.col("size").alias("z3"), F.ceil(F.col("n") / slot_rows).alias("slots"))
    dealt = rows.join(slots, F.col("source").eqNullSafe(F.col("s3")) & (F.col("size") == F.col("z3"))).select("id", "source", "size", "h", F.pmod(F.xxhash64(F.lit(seed), "id", "h"), F.col("slots")).alias("slot"))
    counts = stored(dealt.groupBy("source", "size", "slot").agg(F.count("*").alias("n")), "slots")
    ahead = Window.partitionBy("source").orderBy("size", "slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("s4"), F.col("size").alias("z4"), F.col("slot").alias("k4"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    starts = starts.join(aims, F.col("s4").eqNullSafe(F.col("source"))).drop("source")
    within = Window.partitionBy("source", "size", "slot").orderBy("h", "id")
    ranked = dealt.repartition("source", "size", "slot").withColumn("rank", F.row_number().over(within))
    each = ranked.join(starts, F.col("source").eqNullSafe(F.col("s4")) & (F.col("size") == F.col("z4")) & (F.col("slot") == F.col("k4")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    upto = F.col("first") + F.col("rank")
    taken = F.floor(upto * rate + offset) - F.floor((upto - 1) * rate + offset)
    return each.select("id", "source", "size", "h", "source_size", "target", taken.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """(id, size, source, source_size, target, copies, taken) of each row of docs. Null sources are one source, the
    last; a null text has no words; no rows give none."""
    got = copies(sized(docs, id_col, text_col, source_col), weights, most, seed)
    return got.select("id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    keys = sized(docs, id_col, text_col, source_col)
    got = copies(keys, weights, most, seed)
    got = got.groupBy("id", "source", "size", "h").agg(F.sort_array(F.collect_list("copies")).alias("each")).toDF("__id", "__source", "__size", "__h", "__each")
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    c = {x: F.col(f"c{names.index(x)}") for x in (id_col, text_col, source_col)}
    h = F.xxhash64(c[text_col])
    joined = rows.withColumn("__h0", h).join(got.where("exists(__each, x -> x > 0)"), c[id_col].eqNullSafe(F.col("__id")) & (F.col("__h0") == F.col("__h")) & c[source_col].eqNullSafe(F.col("__source")))
    # rows alike in all of this are told apart by their place; mostly there is one
    place = F.row_number().over(Window.partitionBy("__id", "__h", "__source").orderBy("__id"))
    joined = joined.withColumn("__n", F.element_at("__each", place).cast("int")).where("__n > 0")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)
