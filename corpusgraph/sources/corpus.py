"""Corpus files: shuffled shards, held-out scans, conversations, questions, logs and reports, and metric outputs."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import placed, seeded
from ..operators.tables import require_columns


def read_corpus(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """Texts of Parquet shards: the last file by name is validation, the others train. Names come from the listing, so no
    file is read to find the last."""
    df = spark.read.parquet(path)
    last = max(df.inputFiles(), default="")
    held = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/") == re.sub("^file:/+", "/", unquote(last))
    return df.where(held if split == "val" else ~held)


def read_conversations_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line, messages, error): one JSON array of messages on each line; error names what is wrong with one: fewer than
    two messages, roles that don't alternate from user, or content that isn't text."""
    m = F.from_json("value", "array<struct<role:string,content:string>>")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"), m.alias("messages"))
    turns = F.forall(F.transform("messages", lambda x, i: F.coalesce(x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(False))), lambda ok: ok)
    error = F.when(F.col("messages").isNull(), "not a list").when(F.size("messages") < 2, "too short").when(~turns, "roles").when(F.exists("messages", lambda x: x["content"].isNull()), "content")
    return rows.withColumn("error", error)


def read_questions(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Rows of a CSV of questions; rows without a paper are dropped; the first `most` by paper and question."""
    q = require_columns(spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path), ["paper_id", "question_id", "question_text"])
    q = q.where(F.trim(F.coalesce("paper_id", F.lit(""))) != "")
    return q.orderBy("paper_id", "question_id").limit(most) if most is not None else q


def parse_run_logs(spark: SparkSession, path: str, labels: dict[str, str], zero: tuple[str, ...] = (), done: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(file, path, a column for each label): the last number that follows a label in each log, commas dropped; those in `zero`
    are 0 where a log lacks them. Runs whose keys are in `done` already are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("n"))
    found = []
    for name, label in labels.items():
        v = F.regexp_extract("value", rf"{re.escape(label)}\D*?(-?[0-9][0-9,]*\.?[0-9]*(?:e[+-]?\d+)?)", 1)
        last = F.max_by(F.replace(v, F.lit(","), F.lit("")).try_cast("double"), F.when(v != "", F.col("n")))
        found.append((F.coalesce(last, F.lit(0.0)) if name in zero else last).alias(name))
    runs = lines.groupBy("file", "path").agg(*found)
    return runs if done is None else runs.join(done.select(keys or ["file"]), keys or ["file"], "left_anti")


def parse_report(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(file, metric, value): what stands after the first colon of lines that hold a metric's name."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    metric = F.array(*map(F.lit, names))
    rows = lines.withColumn("metric", F.explode(F.filter(metric, lambda m: F.contains(F.col("value"), m))))
    return rows.select("file", "metric", F.trim(F.regexp_extract("value", r"^[^:]*:(.*)$", 1)).alias("value"))


def shard_rows(docs: DataFrame, key: str, text: str, shard_chars: int, group: int, seed: int = 42, run: int = 64) -> DataFrame:
    """docs with `shard` and `place`: in the order of a seeded hash, a shard closes when it has shard_chars characters
    and its number of documents is a multiple of `group`. All shards but the last, whose documents are the rest, do.

    Sizes of groups are folded in runs of about `run` shards side by side; what a run leaves over, less than a shard, is
    put together with what the others leave and folded once more, one row for each run.
    """
    rows = placed(docs.withColumn("__h", seeded(seed, key)), "__h", [key], name="place")
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    groups = rows.groupBy(F.floor(F.col("place") / group).alias("__g")).agg(F.sum(size).alias("c"), (F.count("*") == group).alias("whole"))
    total = docs.agg(F.sum(size).alias("c"), F.count("*").alias("n")).first()
    per_run = max(1, -(-run * shard_chars * total["n"] // (group * max(1, total["c"] or 0))))

    def fold(items: Column) -> Column:
        """The shard, from 0, of each item in order, and the characters of the one left open."""
        start = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("c"), F.expr("cast(array() as array<int>)").alias("of"))

        def step(acc: Column, x: Column) -> Column:
            c, of = acc["c"] + x["c"], F.concat(acc["of"], F.array(acc["k"]))
            full = (c >= shard_chars) & x["whole"]  # the last group may lack documents
            return F.struct((acc["k"] + full.cast("int")).alias("k"), F.when(full, 0).otherwise(c).cast("long").alias("c"), of.alias("of"))

        return F.aggregate(items, start, step)

    runs = groups.groupBy(F.floor(F.col("__g") / per_run).cast("int").alias("run")).agg(F.sort_array(F.collect_list(F.struct("__g", "c", "whole"))).alias("items"))
    runs = runs.select("run", "items", fold(F.col("items")).alias("f"))
    left = runs.where("f.c > 0 or element_at(f.of, -1) = f.k").agg(F.sort_array(F.collect_list(F.struct("run", F.col("f.c").alias("c"), F.element_at("items.whole", -1).alias("whole")))).alias("items"), F.max("run").alias("last"))
    left = left.select("items", fold(F.col("items")).alias("f")).select(F.explode(F.arrays_zip(F.col("items.run").alias("run"), F.col("f.of").alias("of"))).alias("x"))
    left = left.select(F.col("x.run").alias("run"), F.col("x.of").alias("rest"))
    name = lambda a, b: F.concat_ws("-", F.lpad(a.cast("string"), 6, "0"), F.lpad(b.cast("string"), 5, "0"))
    each = runs.join(left, "run", "left").select("run", "rest", F.col("f.k").alias("open"), F.inline(F.arrays_zip(F.col("items.__g").alias("__g"), F.col("f.of").alias("k"))))
    each = each.select("__g", F.when(F.col("k") < F.col("open"), name(F.col("run"), F.col("k"))).otherwise(F.concat(F.lit("rest-"), F.lpad(F.col("rest").cast("string"), 6, "0"))).alias("shard"))
    rows = rows.withColumn("__g", F.floor(F.col("place") / group))
    return rows.join(each, "__g").select(*docs.columns, "shard", "place")


#: zstd at level 3 in row groups of 1,024 texts, without dictionary and statistics, which texts have no use for.
SHARD_WRITER = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false", "parquet.block.row.count.limit": "1024"}


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", shard_chars: int = 250_000_000, group: int = 1024) -> None:
    """Shuffled shards of texts as Parquet, a folder for each, written as SHARD_WRITER says."""
    rows = shard_rows(docs.select(key, text), key, text, shard_chars, group)
    rows.repartition("shard").sortWithinPartitions("shard", "place").select(text, "shard").write.partitionBy("shard").options(**SHARD_WRITER).mode("overwrite").parquet(path)


def write_conversations(df: DataFrame, path: str) -> None:
    """messages(array<struct<role, content>>) as JSON lines {"conversations": [...]}."""
    df.select(F.to_json(F.struct(F.col("messages").alias("conversations")))).write.mode("overwrite").text(path)


def write_outputs(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV with a header; columns that CSV can't hold go as JSON lines instead."""
    for name, df in tables.items():
        nested = any(t.startswith(("array", "struct", "map")) for _, t in df.dtypes)
        writer = df.write.mode("overwrite")
        writer.json(f"{path}/{name}") if nested else writer.option("header", True).csv(f"{path}/{name}")
