"""Queries of metrics, windows and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import ranking as K
from .fixtures import EDGES_SQL, PAPERS, edges, papers
from .registry import query, table
from .text_queries import _ASKED, _CASES, _asked


def _r(c, n=6):
    return F.round(c, n)


@query("SELECT count(*) FILTER (embedding IS NOT NULL) AS n, count(*) FILTER (embedding IS NOT NULL) >= 100 AS ready FROM embeddings")
def count_where(spark, sf_dir):
    return M.count_where(table(spark, sf_dir, "embeddings"), F.col("embedding").isNotNull(), 100)


@query("""SELECT count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS skipped, CAST(sum(user_id) AS BIGINT) AS sections, CAST(sum(event_id % 7) AS BIGINT) AS chunks, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
(SELECT string_agg(e, '; ' ORDER BY e) FROM (SELECT DISTINCT concat('e', CAST(event_id AS VARCHAR)) AS e FROM events WHERE event_type = 'error' ORDER BY e LIMIT 10)) AS errors FROM events""")
def run_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "skipped").otherwise("done").alias("status"), F.col("user_id").alias("sections"), (F.col("event_id") % 7).alias("chunks"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"))
    return M.run_stats(e).withColumn("success_rate", _r("success_rate"))


@query("SELECT o_custkey AS id, count(*) AS citations FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def citation_counts(spark, sf_dir):
    """Sizes of citation lists, of which some are null."""
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("cited"))
    return M.citation_counts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(lists, "id", "full"))


@query("SELECT label AS cluster_id, coalesce(arg_min(n, vec_id), concat('Cluster ', CAST(label AS VARCHAR))) AS name, sum(m)::BIGINT AS members FROM (SELECT label, vec_id, CASE WHEN label % 2 = 0 THEN concat('v', CAST(vec_id AS VARCHAR)) END AS n, 1 AS m FROM embeddings) GROUP BY label")
def cluster_summary(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"), F.when(F.col("label") % 2 == 0, F.concat(F.lit("v"), F.col("vec_id").cast("string"))).alias("cluster_name"))
    return M.cluster_summary(n)


@query(f"WITH {EDGES_SQL} SELECT count(*) FILTER (kind = 'SUPPORT') AS support, count(*) FILTER (kind = 'CONTRADICT') AS contradict, count(*) FILTER (kind IN ('NEUTRAL', 'CITES')) AS neutral, count(*) FILTER (kind = 'SIMILAR') AS similar FROM edges")
def relation_counts(spark, sf_dir):
    return M.relation_counts(edges(spark, sf_dir))


@query(f"WITH {PAPERS}, {EDGES_SQL} SELECT (SELECT count(*) FROM papers) AS total_nodes, (SELECT count(*) FROM edges) AS total_links")
def graph_meta(spark, sf_dir):
    return M.graph_meta(papers(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH {EDGES_SQL} SELECT count(DISTINCT source_id) AS papers, count(*) FILTER (kind IN ('CITES', 'SIMILAR')) AS deterministic, count(*) FILTER (kind IN ('SUPPORT', 'CONTRADICT', 'NEUTRAL')) AS semantic FROM edges")
def graph_build_stats(spark, sf_dir):
    return M.graph_build_stats(edges(spark, sf_dir))


@query(f"WITH {EDGES_SQL}, c AS (SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'CONTRADICT') SELECT DISTINCT id, CAST(NULL AS BIGINT) AS target_id FROM (SELECT source_id AS id FROM c UNION ALL SELECT target_id FROM c) UNION ALL SELECT source_id, target_id FROM c")
def highlight(spark, sf_dir):
    """Nodes, and links with their target."""
    e = edges(spark, sf_dir)
    nodes = M.highlighted(e, "CONTRADICT").withColumn("target_id", F.lit(None).cast("long"))
    return nodes.unionByName(M.highlighted_links(e, "CONTRADICT").withColumnRenamed("source_id", "id"))


_RANKED = "ranked AS (SELECT o_custkey AS anchor, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderpriority, o_orderstatus FROM orders), relevant AS (SELECT o_custkey AS anchor, o_orderkey AS item FROM orders WHERE o_orderstatus = 'F')"
_METRICS = "f AS (SELECT r.anchor, count(v.item) FILTER (r.rank <= 5) AS h, min(r.rank) FILTER (v.item IS NOT NULL) AS first_rank, count(v.item) AS n FROM ranked r LEFT JOIN relevant v ON r.anchor = v.anchor AND r.item = v.item GROUP BY 1)"


def _ranked(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = o.select(F.col("o_custkey").alias("anchor"), F.col("o_orderkey").alias("item"), F.row_number().over(w).alias("rank"))
    return ranked, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("anchor"), F.col("o_orderkey").alias("item"))


@query(f"WITH {_RANKED}, {_METRICS} SELECT anchor, CAST(h > 0 AS INT) AS hits, round(CASE WHEN n > 0 THEN h / n ELSE 0 END, 6) AS recall, round(coalesce(1 / first_rank, 0), 6) AS mrr, first_rank, n AS n_relevant FROM f")
def retrieval_metrics(spark, sf_dir):
    return M.retrieval_metrics(*_ranked(spark, sf_dir), 5).withColumn("recall", _r("recall")).withColumn("mrr", _r("mrr"))


@query(f"WITH {_RANKED}, {_METRICS} SELECT anchor % 3 AS composition, anchor % 2 AS model, count(*) AS n, round(avg(CAST(h > 0 AS INT)), 6) AS hits, round(avg(CASE WHEN n > 0 THEN h / n ELSE 0 END), 6) AS recall, round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr FROM f GROUP BY 1, 2")
def retrieval_summary(spark, sf_dir):
    m = M.retrieval_metrics(*_ranked(spark, sf_dir), 5).withColumn("composition", F.col("anchor") % 3).withColumn("model", F.col("anchor") % 2)
    return M.retrieval_summary(m, ["composition", "model"]).select("composition", "model", "n", *[_r(c).alias(c) for c in ("hits", "recall", "mrr")])


_ITEMS = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), a AS (SELECT id AS item, e FROM v), se AS (SELECT id // 3 AS item, id % 3 AS sentence, e FROM v), c0 AS (SELECT id // 4 AS item, e FROM v WHERE id // 4 % 5 > 1), ab AS (SELECT id // 2 AS item, e FROM v WHERE id % 2 = 0 AND id // 2 % 5 = 1), c AS (SELECT * FROM c0 UNION ALL SELECT * FROM ab WHERE item NOT IN (SELECT item FROM c0))"


@query(f"""WITH {_ITEMS}, m AS (SELECT a.item, max(list_cosine_similarity(a.e, c.e)) AS best, avg(list_cosine_similarity(a.e, c.e)) AS mean FROM a JOIN c USING (item) GROUP BY 1),
s AS (SELECT item, avg(CASE WHEN best >= 0.1 THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT se.item, se.sentence, max(list_cosine_similarity(se.e, c.e)) AS best FROM se JOIN c USING (item) GROUP BY 1, 2) GROUP BY 1)
SELECT a.item, round(coalesce(best, 0), 5) AS max_similarity, round(coalesce(mean, 0), 5) AS mean_similarity, round(CAST(CASE WHEN best IS NULL THEN 0 ELSE coalesce(share, 0) END AS DOUBLE), 5) AS support FROM a LEFT JOIN m USING (item) LEFT JOIN s USING (item)""")
def answer_support(spark, sf_dir):
    """Each vector is an answer; a third of them are sentences of one, a quarter its chunks, of which some have none."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    part = lambda n: F.floor(F.col("id") / n)
    chunks = v.select(part(4).alias("item"), "embedding").where("item % 5 > 1")
    abstracts = v.where("id % 2 = 0").select(part(2).alias("item"), "embedding").where("item % 5 = 1")
    got = M.answer_support(v.withColumnRenamed("id", "item"), v.select(part(3).alias("item"), (F.col("id") % 3).alias("sentence"), "embedding"), chunks, abstracts, 0.1)
    return got.select("item", *[_r(c, 5).alias(c) for c in ("max_similarity", "mean_similarity", "support")])


@query("SELECT l_partkey AS method, count(*) AS question_count, round(avg(l_quantity), 6) AS support, round(avg(l_discount), 6) AS stability, round(avg(l_tax), 6) AS length FROM lineitem GROUP BY 1")
def qa_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("method"), F.col("l_quantity").alias("support"), F.col("l_discount").alias("stability"), F.col("l_tax").alias("length"))
    return M.qa_summary(l, "method").select("method", "question_count", *[_r(c).alias(c) for c in ("support", "stability", "length")])


@query("SELECT d.source AS composition, d.lang AS model, count(*) AS n, round(avg(CASE WHEN d.doc_id % 4 > 0 THEN l.quality END), 6) AS avg_score, round(avg(l.toxic), 6) AS positive, count(*) FILTER (d.doc_id % 3 = 0) AS cited, count(*) FILTER (d.doc_id % 3 <> 0) AS not_cited FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2")
def bridge_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    k = F.col("doc_id")
    rows = d.select(F.col("source").alias("composition"), F.col("lang").alias("model"), F.when(k % 4 > 0, F.col("quality").cast("string")).otherwise(" ").alias("score"), F.when(F.col("toxic") == 1, " Yes").otherwise("no").alias("label"), (k % 3 == 0).alias("is_cited"))
    return M.bridge_summary(rows, ["composition", "model"]).select("composition", "model", "n", _r("avg_score").alias("avg_score"), _r("positive").alias("positive"), "cited", "not_cited")


@query("""WITH s AS (SELECT l_orderkey AS item, l_linenumber AS method, l_quantity % 3 AS score FROM lineitem), t AS (SELECT *, max(score) OVER (PARTITION BY item) AS top FROM s), u AS (SELECT *, count(*) FILTER (score = top) OVER (PARTITION BY item) AS tied FROM t)
SELECT method, round(avg(score), 6) AS avg_score, round(avg(CASE WHEN score > 0 THEN 1.0 ELSE 0 END), 6) AS positive, round(sum(CASE WHEN score = top THEN 1.0 / tied ELSE 0 END) / count(DISTINCT item), 6) AS win_rate FROM u GROUP BY 1""")
def human_summary(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("method"), (F.col("l_quantity") % 3).alias("score"))
    return M.win_rates(s).select("method", *[_r(c).alias(c) for c in ("avg_score", "positive", "win_rate")])


_ACC = "acc AS (SELECT event_type AS task, avg(CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM events GROUP BY 1)"


def _accuracy(spark, sf_dir):
    return M.task_accuracy(table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), (F.col("user_id") % 3 == 0).alias("is_correct")))


@query(f"WITH {_ACC} SELECT task, round(accuracy, 6) AS accuracy, n FROM acc")
def task_accuracy(spark, sf_dir):
    return _accuracy(spark, sf_dir).withColumn("accuracy", _r("accuracy"))


@query(f"WITH {_ACC}, b AS (SELECT *, length(task) / 20.0 AS baseline FROM acc) SELECT round(avg((accuracy - baseline) / (1 - baseline)), 6) AS core, CASE WHEN count(DISTINCT task) = 5 THEN round(avg((accuracy - baseline) / (1 - baseline)), 6) END AS chat_core, CAST(NULL AS DOUBLE) AS missing FROM b")
def centered_score(spark, sf_dir):
    """Baselines in percent, as shares with all tasks asked for, and with a task that isn't there."""
    a = _accuracy(spark, sf_dir)
    tasks = a.select("task")
    core = M.centered_score(a, tasks.withColumn("baseline", F.length("task") * 5.0), scale=0.01)
    shares = tasks.withColumn("baseline", F.length("task") / 20.0)
    got = [M.centered_score(a, shares, n).select(_r("score").alias(name)) for name, n in (("chat_core", 5), ("missing", 6))]
    return core.select(_r("score").alias("core")).crossJoin(got[0]).crossJoin(got[1])  # one row each


@query("SELECT round(avg(p), 6) AS rate, sum(p)::BIGINT AS passed, count(*) AS total FROM (SELECT l_orderkey, CASE WHEN bool_or(l_quantity > 40) THEN 1 ELSE 0 END AS p FROM lineitem GROUP BY 1)")
def any_pass(spark, sf_dir):
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_quantity") > 40).alias("is_correct"))
    return M.any_pass(samples).withColumn("rate", _r("rate"))


@query("SELECT k, round(avg(CASE WHEN f < k THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT l_orderkey, min(l_linenumber - 1) FILTER (l_quantity > 40) AS f FROM lineitem GROUP BY 1), (SELECT CAST(unnest([1, 2, 3, 4, 5, 6, 7]) AS INT) AS k) GROUP BY 1")
def pass_at_k(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_linenumber") - 1).alias("idx"), (F.col("l_quantity") > 40).alias("is_correct"))
    return M.pass_at_k(s, 7).withColumn("rate", _r("rate"))


@query(f"SELECT {_CASES.format('lower(t)')} AS category, count(*) FILTER (length(t) % 2 = 0) AS correct, count(*) AS total, round(avg(CASE WHEN length(t) % 2 = 0 THEN 1.0 ELSE 0 END), 6) AS accuracy FROM ({_ASKED}) GROUP BY 1")
def category_accuracy(spark, sf_dir):
    asked = _asked(spark, sf_dir).select(F.col("t").alias("question"), (F.length("t") % 2 == 0).alias("is_correct"))
    return M.category_accuracy(asked).withColumn("accuracy", _r("accuracy"))


@query("SELECT l_suppkey AS grp, round(sum(l_discount + 1) / (ln(2.0) * sum(p_size % 4)), 6) AS bpb FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 4 > 0 AND l_partkey % 10 > 0 GROUP BY 1")
def bits_per_byte(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.when(F.col("l_partkey") % 10 == 0, -1).otherwise(F.col("l_partkey")).alias("target"), (F.col("l_discount") + 1).alias("loss"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"), (F.col("p_size") % 4).alias("n_bytes"))
    return M.bits_per_byte(l, b).where(F.col("bpb") < float("inf")).withColumn("bpb", _r("bpb"))


@query("SELECT l_linenumber AS ctx, round(avg(CASE WHEN l_quantity % 10 = l_suppkey % 10 THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY 1")
def token_accuracy(spark, sf_dir):
    target = F.when(F.col("l_partkey") % 7 == 0, -1).otherwise(F.col("l_suppkey") % 10)
    l = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("ctx"), (F.col("l_quantity") % 10).alias("predicted"), target.alias("target"))
    return M.token_accuracy(l, "ctx").withColumn("accuracy", _r("accuracy"))


@query("""WITH m AS (SELECT l_orderkey AS item, l_linenumber % 4 AS option, avg(round(l_quantity)) AS loss FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY loss, option) AS rn FROM m) SELECT item, option AS chosen, option = item % 4 AS correct FROM r WHERE rn = 1""")
def choose_option(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_linenumber") % 4).alias("option"), F.round("l_quantity").alias("loss"), (F.col("l_orderkey") % 4).alias("gold"))
    return M.choose_option(l)


@query("""WITH s AS (SELECT l_orderkey AS item, substring('ABCDEFG', l_linenumber, 1) AS letter, round(l_quantity / 10) AS score FROM lineitem WHERE l_linenumber <= 2 + l_orderkey % 3), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, letter) AS rn FROM s) SELECT item, letter FROM r WHERE rn = 1""")
def choose_letter(spark, sf_dir):
    """Scores of all letters, many of them equal; those of the item's choices count."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.substring(F.lit("ABCDEFG"), F.col("l_linenumber"), F.lit(1)).alias("letter"), F.round(F.col("l_quantity") / 10).alias("score"))
    allowed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.explode(F.split(F.substring(F.lit("ABCDEFG"), F.lit(1), (2 + F.col("o_orderkey") % 3).cast("int")), "")).alias("letter"))
    return M.choose_letter(s, allowed)


@query("SELECT l_orderkey AS item, bool_and(l_returnflag = 'N' OR l_quantity > 10) AS exact FROM lineitem GROUP BY 1")
def exact_span(spark, sf_dir):
    predicted = F.when((F.col("l_returnflag") == "N") | (F.col("l_quantity") > 10), F.col("l_linenumber")).otherwise(-1)
    return M.exact_span(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), predicted.alias("predicted"), F.col("l_linenumber").alias("target")))


_SIZES = "s AS (SELECT lang, CAST(sum(strlen(text)) AS DOUBLE) AS bytes, CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) AS DOUBLE) AS words, CAST(sum(length(text)) AS DOUBLE) AS chars FROM documents GROUP BY 1)"


@query(f"WITH {_SIZES} SELECT lang AS kind, round(bytes / words, 6) AS ratio, round(bytes / chars, 6) AS base_ratio, round((chars - words) / chars * 100, 6) AS diff, CASE WHEN words < chars THEN 'words' ELSE 'chars' END AS better FROM s")
def compression(spark, sf_dir):
    """Words as tokens against characters as tokens."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), F.octet_length("text").alias("bytes"), F.size(T.words(F.col("text"))).alias("words"), F.length("text").alias("chars"))
    sizes = d.select("kind", "bytes", F.explode(F.array(F.struct(F.lit("words").alias("tokenizer"), F.col("words").alias("tokens")), F.struct(F.lit("chars").alias("tokenizer"), F.col("chars").alias("tokens")))).alias("t")).select("kind", "bytes", "t.*")
    return M.compression(sizes, "chars").select("kind", *[_r(c).alias(c) for c in ("ratio", "base_ratio", "diff")], "better")


@query("WITH v AS (SELECT DISTINCT unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS t FROM documents) SELECT count(*) AS n, min(strlen(t)) AS least, max(strlen(t)) AS most, round(avg(strlen(t)), 6) AS mean, round(stddev_samp(strlen(t)), 6) AS std FROM v WHERE t NOT IN ('de', 'the')")
def token_byte_stats(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("token")).distinct()
    return M.token_byte_stats(M.token_bytes(v, ["de", "the"])).withColumn("mean", _r("mean")).withColumn("std", _r("std"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS w FROM documents) GROUP BY 1")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS w FROM documents) GROUP BY 1), p AS (SELECT concat(substring(w, i, 1), ' ', substring(w, i + 1, 1)) AS pair, n FROM (SELECT w, n, unnest(range(1, length(w))) AS i FROM c WHERE length(w) > 1)) SELECT pair, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1""")
def pair_counts(spark, sf_dir):
    return M.pair_counts(word_counts(spark, sf_dir))


@query()
def pretoken_counts(spark, sf_dir):
    """The pattern has look-ahead, which the SQL's patterns lack."""
    return M.pretoken_counts(table(spark, sf_dir, "documents"))


@query()
def pretoken_pairs(spark, sf_dir):
    return M.pair_counts(M.pretoken_counts(table(spark, sf_dir, "documents")))


_SAID = "concat(CASE doc_id % 3 WHEN 0 THEN 'First, ' WHEN 1 THEN 'step first, Step ' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END, CASE doc_id % 4 WHEN 0 THEN ' Therefore 1+2=3, Because #### 3' WHEN 1 THEN ' 4*5' ELSE '' END)"
_COUNT = "(length(t) - length(replace(t, '{}', '')))"
_FORM = "CASE WHEN contains(t, '####') THEN 0.4 ELSE 0 END - CASE WHEN length(t) < 50 THEN 0.2 ELSE 0 END"
_THOUGHT = "least(0.2, 0.04 * (" + " + ".join(_COUNT.format(x) for x in "+-*/=") + ")) + least(0.1, 0.05 * (" + " + ".join(f"CAST(contains(t, '{x}') AS INT)" for x in ("Step", "First", "Then", "Finally", "Therefore", "Because")) + ")) + CASE WHEN length(t) - length(replace(t, chr(10), '')) >= 3 THEN 0.05 ELSE 0 END"


@query(f"SELECT doc_id, round(CAST(c AS DOUBLE), 6) AS plain, round(CAST(c + {_FORM} AS DOUBLE), 6) AS format, round(CAST(c + {_THOUGHT} AS DOUBLE), 6) AS reasoning, round(CAST(c + {_FORM} + {_THOUGHT} AS DOUBLE), 6) AS combined FROM (SELECT doc_id, {_SAID} AS t, CASE WHEN n_chars % 2 = 0 THEN 1.0 ELSE 0.0 END AS c FROM documents)")
def reward(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *[_r(M.reward(F.expr(_SAID), F.col("n_chars") % 2 == 0, mode)).alias(mode) for mode in ("plain", "format", "reasoning", "combined")])


@query("SELECT step, round(avg(r), 6) AS mean_reward, round(avg(l), 6) AS mean_length FROM (SELECT l_suppkey AS step, l_orderkey, avg(l_discount) AS r, avg(l_quantity) AS l FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def rollout_stats(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("step"), F.col("l_orderkey").alias("item"), F.col("l_discount").alias("reward"), F.col("l_quantity").alias("length"))
    return M.rollout_stats(r).select("step", _r("mean_reward").alias("mean_reward"), _r("mean_length").alias("mean_length"))


@query("SELECT *, row_number() OVER (ORDER BY metric <> 'CORE', metric = 'ChatCORE', metric) AS place FROM (SELECT CASE event_type WHEN 'view' THEN 'CORE' WHEN 'click' THEN 'ChatCORE' ELSE event_type END AS metric, coalesce(max(CASE WHEN s = 0 THEN v END), '-') AS base, coalesce(max(CASE WHEN s = 1 THEN v END), '-') AS sft, coalesce(max(CASE WHEN s = 2 THEN v END), '-') AS rl FROM (SELECT event_type, user_id % 3 AS s, format('{:,.4f}', CAST(count(*) AS DOUBLE)) AS v FROM events WHERE NOT (event_type = 'click' AND user_id % 3 = 1) GROUP BY 1, 2) GROUP BY 1)")
def report_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("not (event_type = 'click' and user_id % 3 = 1)")
    stage = F.element_at(F.array(F.lit("base"), F.lit("sft"), F.lit("rl")), (F.col("user_id") % 3 + 1).cast("int"))
    metric = F.expr("case event_type when 'view' then 'CORE' when 'click' then 'ChatCORE' else event_type end")
    got = M.report_matrix(e.groupBy(metric.alias("metric"), stage.alias("stage")).agg(F.count("*").cast("double").alias("value")), ["base", "sft", "rl"])
    return got.withColumn("place", F.col("place").cast("long"))


_RUNS = "runs AS (SELECT o_orderkey AS run, o_orderpriority AS flops_budget, o_totalprice AS tokens_trained, 1000 + o_custkey AS params_transformer, o_custkey % 100 AS params_lm_head, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 100000 END AS val_bpb FROM orders)"


def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("flops_budget"), F.col("o_totalprice").alias("tokens_trained"), (1000 + F.col("o_custkey")).alias("params_transformer"), (F.col("o_custkey") % 100).alias("params_lm_head"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 100000).alias("val_bpb"))


@query(f"WITH {_RUNS} SELECT run, flops_budget, params_transformer + params_lm_head AS effective_params, round(tokens_trained / (params_transformer + params_lm_head), 6) AS ratio, val_bpb FROM runs WHERE val_bpb > 0")
def runs_derived(spark, sf_dir):
    return M.runs_derived(_runs(spark, sf_dir)).select("run", "flops_budget", "effective_params", _r("ratio").alias("ratio"), "val_bpb")


@query(f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY flops_budget ORDER BY val_bpb, run) AS rn FROM runs WHERE val_bpb > 0) SELECT flops_budget, run, val_bpb FROM r WHERE rn = 1")
def best_per_group(spark, sf_dir):
    return M.best_per_group(M.runs_derived(_runs(spark, sf_dir)), "flops_budget")


_FIT = """m AS (SELECT g, avg(x) AS mu FROM p GROUP BY 1), z AS (SELECT p.*, x - mu AS z, mu FROM p JOIN m USING (g)),
q AS (SELECT g, any_value(mu) AS mu, count(*) AS n, sum(z*z) AS z2, sum(z*z*z) AS z3, sum(z*z*z*z) AS z4, sum(y) AS y0, sum(y*z) AS y1, sum(y*z*z) AS y2 FROM z GROUP BY 1),
d AS (SELECT *, n * (z2 * z4 - z3 * z3) - z2 * z2 * z2 AS det FROM q), f AS (SELECT g, mu, (n * (z2 * y2 - z3 * y1) - z2 * z2 * y0) / det AS a, (n * (z4 * y1 - z3 * y2) + z2 * z3 * y0 - z2 * z2 * y1) / det AS bz, y0, z2, n FROM d WHERE abs(det) > 0),
fit AS (SELECT g, a, bz - 2 * a * mu AS b, (y0 - a * z2) / n - bz * mu + a * mu * mu AS c, CASE WHEN a > 0 THEN mu - bz / (2 * a) END AS vx FROM f)"""


@query(f"""WITH {_RUNS}, p AS (SELECT *, flops_budget AS g, log10(params_transformer + params_lm_head) AS x, val_bpb AS y, tokens_trained / (params_transformer + params_lm_head) AS ratio FROM runs WHERE val_bpb > 0), {_FIT},
j AS (SELECT p.*, fit.a, fit.b, fit.c, fit.vx, row_number() OVER (PARTITION BY p.g ORDER BY p.y, p.x) AS rn FROM p LEFT JOIN fit USING (g)),
o AS (SELECT g, any_value(vx) AS vx, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, max(x) FILTER (x <= vx) AS lo, min(x) FILTER (x >= vx) AS hi, max({{'x': x, 'r': ratio, 't': tokens_trained}}) FILTER (x <= vx) AS l, min({{'x': x, 'r': ratio, 't': tokens_trained}}) FILTER (x >= vx) AS h, max({{'x': x, 'y': y, 'r': ratio, 't': tokens_trained}}) FILTER (rn = 1) AS best FROM j GROUP BY 1)
SELECT g AS flops_budget, round(log10(CASE WHEN vx IS NULL THEN pow(10, best.x) ELSE pow(10, vx) END), 4) AS log_params, round(CASE WHEN vx IS NULL THEN best.y ELSE a * vx * vx + b * vx + c END, 4) AS bpb FROM o""")
def optimum(spark, sf_dir):
    """Interpolated tokens and ratios depend on ties of equal parameters, so a test of its own holds them."""
    got = M.optimum(M.runs_derived(_runs(spark, sf_dir)), "flops_budget")
    return got.select("flops_budget", _r(F.log10("params"), 4).alias("log_params"), _r("bpb", 4).alias("bpb"))


@query("SELECT l_returnflag AS flag, round(regr_slope(log10(l_extendedprice), log10(l_quantity)), 6) AS slope, round(regr_intercept(log10(l_extendedprice), log10(l_quantity)), 6) AS intercept, round(regr_r2(log10(l_extendedprice), log10(l_quantity)), 6) AS r2 FROM lineitem GROUP BY 1")
def linear_fit(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.log10("l_quantity").alias("x"), F.log10("l_extendedprice").alias("y"))
    return M.linear_fit(l, "x", "y", "flag").select("flag", *[_r(c).alias(c) for c in ("slope", "intercept", "r2")])


@query(f"""WITH p AS (SELECT l_returnflag AS g, log10(l_quantity) AS x, l_extendedprice AS y FROM lineitem), {_FIT}
SELECT g AS l_returnflag, round(a, 3) AS a, round(b, 3) AS b, round(c, 3) AS c, round(pow(10, vx), 4) AS vertex FROM fit""")
def quadratic_fit(spark, sf_dir):
    got = M.quadratic_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return got.select("l_returnflag", *[_r(c, 3).alias(c) for c in "abc"], _r("vertex", 4).alias("vertex"))


@query("SELECT label, CAST(pos AS INT) AS pos, round(avg(v), 5) AS mean FROM (SELECT label, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2")
def mean_vector(spark, sf_dir):
    m = M.mean_vector(table(spark, sf_dir, "embeddings"), "label")
    return m.select("label", F.posexplode("mean").alias("pos", "mean")).withColumn("mean", _r("mean", 5))


@query("SELECT vec_id AS source_id, (vec_id * (pos + 3)) % 500 AS target_id, round(greatest(CAST(0 AS DOUBLE), CAST(1 - 0.1 * pos AS DOUBLE)), 6) AS strength FROM (SELECT vec_id, unnest(range(12)) AS pos FROM embeddings)")
def similar_edges(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda p: (F.col("vec_id") * (p + 3)) % 500).alias("neighbours"))
    return K.similar_edges(n).select("source_id", "target_id", _r("strength").alias("strength"))


_BUDGET = "b AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars % 100 DESC, doc_id) AS rn, sum(length(text)) OVER (PARTITION BY source ORDER BY n_chars % 100 DESC, doc_id) AS chars FROM documents WHERE trim(text) <> '')"


@query(f"WITH {_BUDGET} SELECT source, doc_id, rn FROM b WHERE (rn = 1 OR chars <= 12000) AND rn <= 8")
def budget_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return K.budget_prefix(d, ["source"], [F.desc(F.col("n_chars") % 100), F.col("doc_id")], "text", 12000, 8).select("source", "doc_id", F.col("rn").cast("long").alias("rn"))


_NAMES = ["abstract", "methods", "results", "conclusion", "discussion", "body"]
_PICK = f"CASE doc_id % 6 {' '.join(f'WHEN {i} THEN {chr(39)}{n}{chr(39)}' for i, n in enumerate(_NAMES))} END"


@query(f"WITH c AS (SELECT source, doc_id, {_PICK} AS name, length(text) // 4 AS tokens, doc_id % 6 AS p FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, tokens DESC, doc_id) AS rn FROM c) SELECT source, doc_id, name, rn FROM r WHERE rn <= 15")
def prioritized_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("source", "doc_id", F.expr(_PICK).alias("name"), F.floor(F.length("text") / 4).alias("token_estimate"), F.col("doc_id").alias("section_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"))
    return K.prioritized_chunks(c, ["source"], 5).select("source", "doc_id", "name", F.col("rn").cast("long").alias("rn"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) SELECT conv_id, string_agg(concat(upper(role), ': ', text), chr(10) ORDER BY turn) AS history FROM r WHERE rn <= 3 GROUP BY 1")
def recent_history(spark, sf_dir):
    return K.recent_history(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 3)


@query("SELECT c.conv_id, f.field, c.turn AS chunk, c.rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations) c, (SELECT unnest(['research_question', 'methods', 'main_claims', 'key_findings', 'limitations', 'conclusion']) AS field) f")
def evidence_rows(spark, sf_dir):
    """Turns stand for a paper's chunks."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("chunk"))
    return K.evidence_rows(c, "conv_id", "chunk", ["chunk"]).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT l_orderkey AS item, l_linenumber AS idx, round(l_discount - avg(l_discount) OVER (PARTITION BY l_orderkey), 6) + 0.0 AS advantage FROM lineitem")
def advantages(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("idx"), F.col("l_discount").alias("reward"))
    return K.advantages(l).select("item", "idx", (_r("advantage") + 0.0).alias("advantage"))


@query("WITH s AS (SELECT doc_id, substring(text, 1, 2000) AS text FROM documents), c AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM s) SELECT doc_id, length(text) AS n FROM c WHERE ahead <= 150000")
def char_budget_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return K.char_budget_sample(d, "doc_id", "text", 2000, 150_000).select("doc_id", F.length("text").cast("long").alias("n"))


@query("""WITH RECURSIVE v AS (SELECT c_nationkey AS run, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS step, c_custkey, c_acctbal AS x FROM customer), e AS (SELECT run, step, c_custkey, 0.1 * x AS s FROM v WHERE step = 1 UNION ALL SELECT v.run, v.step, v.c_custkey, 0.9 * e.s + 0.1 * v.x FROM e JOIN v ON v.run = e.run AND v.step = e.step + 1)
SELECT run, c_custkey, round(s / (1 - pow(0.9, step)), 4) AS ema FROM e""")
def ema(spark, sf_dir):
    return K.ema(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_acctbal").select(F.col("c_nationkey").alias("run"), "c_custkey", _r("ema", 4).alias("ema"))


@query(f"WITH {PAPERS}, p AS (SELECT *, id % 7 AS n_citations, CAST(length(trim(coalesce(tldr, ''))) > 0 AS INT) + CAST(length(trim(coalesce(conclusion, ''))) > 0 AS INT) + least(5, id % 7) AS richness FROM papers WHERE length(trim(coalesce(title, ''))) > 0 AND length(trim(coalesce(abstract, ''))) > 0 AND id % 7 >= 1) SELECT id, richness FROM p ORDER BY richness DESC, length(abstract) DESC, md5(concat_ws('|', '7', CAST(id AS VARCHAR))), id LIMIT 50")
def select_anchors(spark, sf_dir):
    return K.select_anchors(papers(spark, sf_dir).withColumn("n_citations", F.col("id") % 7), 50).select("id", "richness")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '1337', CAST(doc_id AS VARCHAR))), doc_id) AS rn FROM documents) WHERE rn <= 10")
def subsample(spark, sf_dir):
    return K.subsample(table(spark, sf_dir, "documents"), "source", "doc_id", 10).select("source", "doc_id")


@query("""WITH p AS (SELECT source AS task, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '1234', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS size FROM documents),
w AS (SELECT task, item, unnest(range(1, 6)) AS place, i, size FROM p) SELECT w.task, w.item, p.item AS shot, CAST(w.place AS INT) AS place FROM w JOIN p ON w.task IS NOT DISTINCT FROM p.task AND (w.i + w.place) % w.size = p.i WHERE w.place < w.size""")
def fewshot(spark, sf_dir):
    return K.fewshot(table(spark, sf_dir, "documents").select(F.col("source").alias("task"), F.col("doc_id").alias("item")), 5)


@query("SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 20")
def recent_ids(spark, sf_dir):
    return K.recent_ids(table(spark, sf_dir, "documents"), 20, "doc_id")


@query(f"WITH {PAPERS}, q AS (SELECT item_id AS query, substring(text, 1, 3) AS word FROM benchmark), h AS (SELECT q.query, p.id, 0 AS r FROM q JOIN papers p ON q.query % 2 = 0 AND p.id = q.query UNION ALL SELECT q.query, p.id, 1 FROM q JOIN papers p ON p.id % 200 = q.query AND q.query % 3 = 0 UNION ALL SELECT q.query, p.id, 2 FROM q, (SELECT id FROM papers ORDER BY id DESC LIMIT 3) p), b AS (SELECT *, min(r) OVER (PARTITION BY query) AS best FROM h) SELECT query, id, r AS source_rank FROM b WHERE r = best")
def query_with_fallback(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"))
    p = papers(spark, sf_dir).select("id")
    vector = q.where("query % 2 = 0").join(p, F.col("query") == F.col("id"))
    words = q.where("query % 3 = 0").join(p, F.col("query") == F.col("id") % 200)
    newest = q.crossJoin(p.orderBy(F.desc("id")).limit(3))  # three rows for each query
    return K.with_fallback(vector, words, newest).select("query", "id", "source_rank")


