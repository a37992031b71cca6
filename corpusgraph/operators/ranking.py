"""Windows, budgets, samples and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def similar_edges(neighbours: DataFrame) -> DataFrame:
    """neighbours(id, neighbours array) -> SIMILAR edges whose strength falls by 0.1 for each place."""
    rows = neighbours.select(F.col("id").alias("source_id"), F.posexplode("neighbours").alias("pos", "target_id"))
    return rows.select("source_id", "target_id", F.lit("SIMILAR").alias("kind"), F.greatest(F.lit(0.0), 1 - 0.1 * F.col("pos")).alias("strength"))


def budget_prefix(df: DataFrame, by: list[str], order: list, text: str, max_chars: int, k: int, extra: int = 0) -> DataFrame:
    """Within each group, in order: blank texts skipped, the first kept, the others while their characters (and `extra`
    for each earlier one) fit the budget and fewer than k are kept. The running sum never falls, so it cuts a prefix."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where(F.trim(text) != "").withColumn("rn", F.row_number().over(w)).withColumn("chars", F.sum(F.length(text)).over(run) + extra * (F.col("rn") - 1))
    return rows.where(((F.col("rn") == 1) | (F.col("chars") <= max_chars)) & (F.col("rn") <= k))


#: Order of section names when chunks are chosen for a summary.
PRIORITY = {"abstract": 0, "methods": 1, "results": 2, "conclusion": 3, "discussion": 4}


def priority(name: Column) -> Column:
    out = F.lit(5)
    for n, p in PRIORITY.items():
        out = F.when(name == n, p).otherwise(out)
    return out


def prioritized_chunks(chunks: DataFrame, by: list[str], limit: int, max_chars: int | None = None) -> DataFrame:
    """chunks(by, name, token_estimate, section_id, chunk_index, chunk_text) with rn: the first 3 * limit of each group by
    section, the longer before the shorter; with max_chars, as many of those, up to the limit, as fit."""
    order = [priority(F.col("name")), F.desc("token_estimate"), F.col("section_id"), F.col("chunk_index")]
    rows = chunks.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= 3 * limit)
    return rows if max_chars is None else budget_prefix(rows.drop("rn"), by, order, "chunk_text", max_chars, limit)


#: Fields of a summary that need evidence.
FIELDS = ["research_question", "methods", "main_claims", "key_findings", "limitations", "conclusion"]


def evidence_rows(chunks: DataFrame, by: str, chunk: str, order: list) -> DataFrame:
    """(by, field, chunk, rank): each field of a group's summary with each of its chunks, in their order."""
    rows = chunks.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return rows.select(by, F.explode(F.array(*map(F.lit, FIELDS))).alias("field"), chunk, "rank")


def recent_ids(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The n largest ids."""
    return df.select(key).orderBy(F.desc(key)).limit(n)


def recent_history(turns: DataFrame, by: list[str], order: str | list[str], n: int) -> DataFrame:
    """The last n messages of each group in their order, as "ROLE: message" lines; order names the columns that tell
    which comes later, the time and then, for equal times, the log's id."""
    order = [order] if isinstance(order, str) else order
    w = Window.partitionBy(*by).orderBy(*map(F.desc, order))
    last = turns.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    line = F.concat(F.upper("role"), F.lit(": "), "text")
    return last.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


def advantages(rewards: DataFrame) -> DataFrame:
    """rewards(item, idx, reward) with what each is above the mean of its item."""
    return rewards.withColumn("advantage", F.col("reward") - F.avg("reward").over(Window.partitionBy("item")))


def ranged(df: DataFrame, order: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(rows, ranges): df cut into ranges of its order, whatever its type, as a table (order, value, range), and for each
    range its first sum: (range, before), the sum of value in all ranges ahead. Ranges are even in rows however sparse
    or clustered the keys are; only the ranges' totals, one for each task, meet in one window."""
    path = scratch(df.sparkSession, "ranges")
    cut = df.select(*order, F.col(value).cast("long").alias(value)).repartitionByRange(*order)
    cut.withColumn("__range", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    totals = rows.groupBy("__range").agg(F.sum(value).alias("__t"))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return rows, totals.select("__range", "__t", F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__before"))


def running_sum(df: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """(order, value, name): the sum of value in all rows that stand ahead of each one; of equal rows any comes first."""
    rows, ranges = ranged(df, order, value)
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("__own", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return own.join(ranges, "__range").select(*order, value, (F.col("__before") + F.col("__own")).alias(name))


def char_budget_sample(docs: DataFrame, key: str, text: str, cap: int, most: int) -> DataFrame:
    """Rows in order of key, texts cut at cap characters, up to and with the row that passes `most` characters; rows of
    that one's key all come. Only keys and lengths are put in order, and only the range in which the budget ends is summed
    row by row."""
    cut = F.substring(text, 1, cap)
    sizes = docs.select(key, F.coalesce(F.length(cut), F.lit(0)).alias("__n"))
    rows, ranges = ranged(sizes, [key], "__n")
    last = ranges.where((F.col("__before") <= most) & (F.col("__before") + F.col("__t") > most))
    w = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    passed = rows.join(F.broadcast(last), "__range").withColumn("__sum", F.col("__before") + F.sum("__n").over(w)).where(F.col("__sum") > most)  # last is one row
    end = passed.agg(F.min(F.struct("__sum", key)).alias("e")).select(F.col(f"e.{key}").alias("__end"))
    kept = docs.join(F.broadcast(end), F.col("__end").isNull() | F.col(key).isNull() | (F.col(key) <= F.col("__end")))  # one row, null if all fit
    return kept.withColumn(text, cut).select(docs.columns)


def ema(df: DataFrame, by: str, order: str, value: str, beta: float = 0.9, width: int = 256) -> DataFrame:
    """(by, order, ema): the moving average of each run without its bias towards zero at the start. A run is cut into
    blocks of its numeric order; each is folded on its own, and only a row for each block is folded over the run."""
    row = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    blocks = df.groupBy(by, F.floor(F.col(order) / width).alias("b")).agg(F.sort_array(F.collect_list(row)).alias("r"))

    def step(acc, x):
        s = beta * acc["s"] + (1 - beta) * x["v"]
        return F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out"))

    start = F.struct(F.lit(0.0).alias("s"), F.expr("cast(array() as array<double>)").alias("out"))
    blocks = blocks.select(by, "b", F.col("r.o").alias("o"), F.aggregate("r", start, step)["out"].alias("e"))

    def carry(acc, x):
        now = F.struct(x["b"].alias("b"), acc["s"].alias("s"), acc["n"].alias("n"))
        return F.struct((F.pow(F.lit(beta), x["n"]) * acc["s"] + x["s"]).alias("s"), (acc["n"] + x["n"]).alias("n"), F.concat(acc["out"], F.array(now)).alias("out"))

    ends = blocks.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("b", F.size("e").alias("n"), F.element_at("e", -1).alias("s")))).alias("x"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<b:bigint,s:double,n:int>>)").alias("out"))
    before = ends.select(F.col(by).alias("__run"), F.inline(F.aggregate("x", zero, carry)["out"])).toDF("__run", "__block", "__s", "__n")
    rows = blocks.join(before, F.col(by).eqNullSafe(F.col("__run")) & (F.col("b") == F.col("__block"))).select(by, "__s", "__n", F.posexplode(F.arrays_zip("o", "e")).alias("i", "x"))
    i = F.col("i") + 1
    return rows.select(by, F.col("x.o").alias(order), ((F.col("x.e") + F.pow(F.lit(beta), i) * F.col("__s")) / (1 - F.pow(F.lit(beta), F.col("__n") + i))).alias("ema"))


def seeded(seed: int, *columns: str) -> Column:
    """A hash, as hexadecimal digits, that orders rows at random but alike in each run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def placed(df: DataFrame, h: str, ties: list[str], by: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """df with each row's place, from 0, in the order of a seeded() hash within its group. Rows are ranked among those
    whose hash begins alike, and what goes before those is counted, so a hot group is spread over 4,096 tasks."""
    rows = df.withColumn("__slot", F.substring(h, 1, 3))
    counts = rows.groupBy(*by, "__slot").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*by, "__slot", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy(*by, "__slot").orderBy(h, *ties)) - 1
    return rows.withColumn("__rank", rank).join(first, [*by, "__slot"]).withColumn(name, F.col("__first") + F.col("__rank")).drop("__slot", "__first", "__rank")


def subsample(df: DataFrame, by: str, key: str, n: int, seed: int = 1337) -> DataFrame:
    """n rows of each group, by seeded hash."""
    w = Window.partitionBy(by).orderBy(seeded(seed, key), key)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def fewshot(items: DataFrame, n: int, seed: int = 1234) -> DataFrame:
    """(task, item, shot, place): n other items of the same task for each item, never itself. Items of a task stand in
    seeded order and each takes those that follow it, round the end, so nothing is joined with all others."""
    rows = placed(items.select("task", "item").withColumn("h", seeded(seed, "item")), "h", ["item"], ("task",), "i")
    sizes = items.groupBy("task").agg(F.count("*").alias("size"))
    rows = rows.join(sizes, "task")
    wanted = rows.select("task", F.col("item").alias("asker"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("place"), "i", "size").where(F.col("place") < F.col("size"))
    wanted = wanted.select("task", "asker", "place", ((F.col("i") + F.col("place")) % F.col("size")).alias("j"))
    shots = rows.select(F.col("task").alias("t"), F.col("i").alias("k"), F.col("item").alias("shot"))
    return wanted.join(shots, (F.col("task") == F.col("t")) & (F.col("j") == F.col("k"))).select("task", F.col("asker").alias("item"), "shot", "place")


def with_fallback(*found: DataFrame) -> DataFrame:
    """For each query the rows of the first table that has any for it."""
    rows = None
    for n, f in enumerate(found):
        f = f.withColumn("source_rank", F.lit(n))
        rows = f if rows is None else rows.unionByName(f)
    best = F.min("source_rank").over(Window.partitionBy("query"))
    return rows.withColumn("best", best).where("source_rank = best").drop("best")


def select_anchors(papers: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """The n richest papers with title, abstract and a resolved citation: tldr and conclusion count one each and up to
    five citations, then the longer abstract, then a seeded hash."""
    given = lambda c: (F.length(F.trim(F.coalesce(c, F.lit("")))) > 0).cast("int")
    rich = given("tldr") + given("conclusion") + F.least(F.lit(5), F.col("n_citations"))
    ok = papers.where((given("title") == 1) & (given("abstract") == 1) & (F.col("n_citations") >= 1))
    return ok.withColumn("richness", rich).orderBy(F.desc("richness"), F.desc(F.length("abstract")), seeded(seed, "id"), "id").limit(max(1, n))
