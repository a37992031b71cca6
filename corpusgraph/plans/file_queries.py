"""Queries of sources, sinks and streams: each writes files of the given tables and reads them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.tables import union_edges
from ..sources import corpus as S
from ..sources.scratch import scratch
from ..streaming import incremental as I
from .fixtures import PAPERS, REFS, papers, references
from .registry import query, table


@query("SELECT md5(coalesce(text, '')) AS digest FROM documents")
def read_corpus(spark, sf_dir):
    """Shards of all documents, then those that train and those held out, together all again."""
    path = scratch(spark, "shards")
    S.write_shards(table(spark, sf_dir, "documents"), path, shard_chars=200_000, group=16)
    return S.read_corpus(spark, path).unionByName(S.read_corpus(spark, path, "val")).select(F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def _messages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return each.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


@query("""WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations)
SELECT md5(string_agg(concat(role, chr(10), coalesce(text, '')), chr(10) ORDER BY i)) AS digest, CASE WHEN count(*) < 2 THEN 'too short' WHEN bool_or(role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) THEN 'roles' WHEN bool_or(text IS NULL) THEN 'content' END AS error FROM t GROUP BY conv_id""")
def read_conversations(spark, sf_dir):
    """Conversations as JSON lines, read again with what is wrong with each."""
    path = scratch(spark, "conversations")
    _messages(spark, sf_dir).select(F.to_json("messages", {"ignoreNullFields": "false"})).write.text(path)
    rows = S.read_conversations_jsonl(spark, path)
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")))), "\n")
    return rows.select(F.md5(said).alias("digest"), "error")


@query("""WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations) SELECT conv_id, CAST(i AS INT) AS pos, role, text AS content FROM t""")
def write_conversations(spark, sf_dir):
    """Conversations written for export; the id travels as a leading message that isn't shown."""
    path = scratch(spark, "export")
    rows = _messages(spark, sf_dir).select(F.concat(F.array(F.struct(F.lit("id").alias("role"), F.col("conv_id").cast("string").alias("content"))), F.col("messages")).alias("messages"))
    S.write_conversations(rows, path)
    back = spark.read.schema("conversations array<struct<role:string,content:string>>").json(path)
    got = back.select(F.col("conversations")[0]["content"].cast("long").alias("conv_id"), F.posexplode(F.slice("conversations", 2, 1 << 30)).alias("pos", "m"))
    return got.select("conv_id", "pos", "m.role", "m.content")


@query("SELECT paper_id, question_id, question_text FROM (SELECT CAST(source AS VARCHAR) AS paper_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS question_id, concat('Why, \"', lang, '\"?') AS question_text FROM documents WHERE doc_id % 5 <> 0 AND trim(source) <> '') ORDER BY paper_id, question_id LIMIT 60")
def read_questions(spark, sf_dir):
    path = scratch(spark, "questions")
    d = table(spark, sf_dir, "documents")
    q = d.select(F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("source")).alias("paper_id"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("question_id"), F.concat(F.lit('Why, "'), "lang", F.lit('"?')).alias("question_text"))
    q.write.option("header", True).option("escape", '"').csv(path)
    return S.read_questions(spark, path, 60)


#: A log for each kind of order, with a line for each order, as SQL of both engines.
_RUN = "CAST(substring(o_orderpriority, 1, 1) AS INT) * 10 + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
_LOG = "concat('run_id: ', {run}, ' of order ', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat(', params: ', o_custkey * 7, ',000') ELSE '' END, CASE WHEN {run} % 3 = 0 THEN concat(', CORE ', o_orderkey) ELSE '' END)"


def _logs(spark, sf_dir, what):
    path = scratch(spark, what)
    o = table(spark, sf_dir, "orders").withColumn("run", F.expr(_RUN))
    o.select("run", "o_orderkey", F.expr(_LOG.format(run="run")).alias("line")).repartition("run").sortWithinPartitions("run", "o_orderkey").select("run", "line").write.partitionBy("run").text(path)
    return path


@query(f"""WITH o AS (SELECT *, {_RUN} AS run FROM orders) SELECT CAST(run AS BIGINT) AS run, CAST(arg_max(o_custkey * 7000, o_orderkey) FILTER (o_orderkey % 2 = 0) AS DOUBLE) AS params, CAST(CASE WHEN run % 3 = 0 THEN max(o_orderkey) ELSE 0 END AS DOUBLE) AS core FROM o WHERE run NOT IN (20, 31) GROUP BY run""")
def parse_run_logs(spark, sf_dir):
    """The last numbers of each log; two of the runs are known already."""
    path = _logs(spark, sf_dir, "logs")
    done = spark.createDataFrame([(20.0,), (31.0,)], "run double")
    got = S.parse_run_logs(spark, f"{path}/*", {"run": "run_id:", "params": "params:", "core": "CORE"}, ("core",), done, ["run"])
    return got.select(F.col("run").cast("long").alias("run"), "params", "core")


@query("SELECT o_orderkey AS id, 'run_id' AS metric FROM orders UNION ALL SELECT o_orderkey, 'params' FROM orders WHERE o_orderkey % 2 = 0")
def parse_report(spark, sf_dir):
    got = S.parse_report(spark, _logs(spark, sf_dir, "reports") + "/*", ["run_id", "params"])
    return got.select(F.regexp_extract("value", r"order (\d+)", 1).cast("long").alias("id"), "metric")


@query("SELECT 'a' AS name, c_custkey AS id, c_name AS said FROM customer UNION ALL SELECT 'b', n_nationkey, concat(n_name, '|', CAST(n_regionkey AS VARCHAR)) FROM nation")
def write_outputs(spark, sf_dir):
    """A flat table as CSV and a nested one as JSON lines, read again."""
    path = scratch(spark, "outputs")
    n = table(spark, sf_dir, "nation")
    S.write_outputs({"a": table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "b": n.select("n_nationkey", F.array("n_name", F.col("n_regionkey").cast("string")).alias("x"))}, path)
    a = spark.read.option("header", True).csv(f"{path}/a").select(F.lit("a").alias("name"), F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("said"))
    b = spark.read.schema("n_nationkey long, x array<string>").json(f"{path}/b")
    return a.unionByName(b.select(F.lit("b").alias("name"), F.col("n_nationkey").alias("id"), F.array_join("x", "|").alias("said")))


@query("SELECT DISTINCT concat('e', CAST(user_id AS VARCHAR)) AS entry_id, true AS has_id, true AS has_time FROM events")
def stream_land(spark, sf_dir):
    """Events as files of raw records in two steps, the second with older times and repeats of the first."""
    path = scratch(spark, "landing")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("entry_id"), F.col("event_id").alias("id"), "event_type", "ts")
    for part, at in ((0, F.col("ts")), (1, F.col("ts") - F.expr("interval 3 days"))):
        e.where(F.col("id") % 2 == part).select("entry_id", "id", F.col("event_type").alias("title"), at.alias("at")).write.mode("append").json(f"{path}/raw")
        I.stream_land(spark, f"{path}/raw", f"{path}/bronze", f"{path}/cp").awaitTermination()
    got = spark.read.parquet(f"{path}/bronze")
    return got.select("entry_id", (F.col("ingestion_id") == F.xxhash64("entry_id")).alias("has_id"), F.col("ingested_at").isNotNull().alias("has_time"))


_PAPER_ROW = ["id", "arxiv_id", "ss_id", "doi", "title", "abstract", "full_text", "conclusion", "tldr"]


def _streamed(spark, sf_dir):
    """The pipeline over two steps of files: half of the papers, then all of them with new titles. One in six of those that
    have an ss_id has no arxiv_id."""
    path = scratch(spark, "pipeline")
    p = papers(spark, sf_dir).withColumn("arxiv_id", F.when((F.col("id") % 6 != 1) | F.col("ss_id").isNull(), F.col("arxiv_id")))
    refs = references(p).groupBy(F.col("paper_id").alias("id")).agg(F.collect_list(F.struct("ss_paper_id", "arxiv_id", "doi")).alias("refs"))
    rows = p.select(*_PAPER_ROW, F.lit("api").alias("full_text_source")).join(refs, "id").withColumn("neighbours", F.array(F.col("id") + 1, F.col("id") + 2))
    for step in (rows.where("id % 2 = 0"), rows.withColumn("title", F.concat(F.lit("new "), "title"))):
        step.write.mode("append").option("compression", "gzip").json(f"{path}/raw")
        I.stream_pipeline(spark, f"{path}/raw", f"{path}/out", f"{path}/cp").awaitTermination()
    return f"{path}/out"


@query(f"WITH {PAPERS} SELECT id, concat('new ', title) AS title, CASE WHEN id % 6 <> 1 OR ss_id IS NULL THEN arxiv_id END AS arxiv_id, md5(full_text) AS digest FROM papers")
def stream_pipeline(spark, sf_dir):
    got = I.current_papers(spark, _streamed(spark, sf_dir))
    return got.select("id", "title", "arxiv_id", F.md5("full_text").alias("digest"))


@query(f"""WITH {PAPERS}, {REFS}, x AS (SELECT r.paper_id AS s, p.id AS t, 'CITES' AS kind, 1.0 AS strength FROM refs r JOIN papers p ON r.ss_paper_id = p.ss_id OR (r.arxiv_id = p.arxiv_id AND (p.id % 6 <> 1 OR p.ss_id IS NULL)) OR lower(r.doi) = lower(p.doi) UNION ALL SELECT id, id + 1, 'SIMILAR', 1.0 FROM papers UNION ALL SELECT id, id + 2, 'SIMILAR', 0.9 FROM papers)
SELECT s AS source_id, t AS target_id, kind, round(CAST(max(strength) AS DOUBLE), 6) AS strength FROM x WHERE s <> t GROUP BY 1, 2, 3""")
def stream_edges(spark, sf_dir):
    got = I.current(spark, _streamed(spark, sf_dir) + "/edges", ["source_id", "target_id", "kind"])
    return got.select("source_id", "target_id", "kind", F.round("strength", 6).alias("strength"))


@query("""WITH r AS (SELECT conv_id, role, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) SELECT conv_id AS session, string_agg(concat(upper(role), ': ', coalesce(text, '')), chr(10) ORDER BY turn) AS history FROM r WHERE rn <= 2 GROUP BY 1""")
def stream_history(spark, sf_dir):
    """Turns as a stream; the newest two of each conversation after the last batch."""
    path = scratch(spark, "history")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn"))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), at.alias("at"), "role", F.coalesce("text", F.lit("")).alias("text"))
    c.write.json(f"{path}/raw")
    turns = spark.readStream.schema("session long, at timestamp, role string, text string").json(f"{path}/raw")
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    I.stream_history(turns, 2).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    return I.current(spark, f"{path}/out", ["session"])
