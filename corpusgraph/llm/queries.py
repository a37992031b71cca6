"""The queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, hard_negatives, html_extract, line_dedup, mixing, prefix_tree, quality, simhash, substrings, token_counts, token_ids
from .common import stored, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "edits")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different line of the documents at its first place, with its class and number of links."""
    found = line_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "line", F.col("copies").alias("n_copies"), F.col("class_id").alias("class_doc_id"), "class_line", F.col("links").alias("n_links"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema)
    records = chat.records(turns).unionByName(chat.records(more))  # apart, so that a -1 of the table stays its own
    formatted = stored(chat.format_records(records, "id"), "formatted")
    return chat.digests(formatted).withColumnRenamed("id", "conv_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_texts(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after its personal data and secrets are marked."""
    kept = stored(token_counts.trees(table(spark, sf_dir, "documents")), "trees")
    return token_counts.counted(token_counts.edited(kept, token_counts.scrub(token_counts.text_of()))).withColumnRenamed("id", "doc_id")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_tree.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(hard_negatives.prepared(moved), F.col("id") % 50 == 0)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = alignment.align(table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_lines, op3_token_ids, op4_chat, op5_simhash, op6_substrings, op7_html, op8_quality, op9_mix, op10_token_counts, op11_ngram_join, op12_hard_negatives, op13_align)}

#: Escaping of control strings, as in chat.escape, and the length that the template adds to a turn.
_ESCAPED = r"regexp_replace(coalesce(text, ''), '(\\*)(" + chat.CONTROL + r")', '\1\1\\\2', 'g')"
_FRAME = "CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 12 WHEN 'system' THEN 14 ELSE 17 + length(regexp_replace(role, '([\\]\\\\])', '\\\\\\1', 'g')) END"

_OP4 = f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length({_ESCAPED}) + {_FRAME} AS n FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 24 + 16 UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 24 + 12)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(4 + sum(n) AS BIGINT) AS formatted_chars FROM t GROUP BY 1"""

#: The pages' own marks; character references are those that the table holds.
_OP7 = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS h FROM pages),
p AS (SELECT page_id, url, string_split_regex(regexp_replace(regexp_replace(h, '</?(b|i|em|strong|a)( [^>]*)?>', '', 'g'), '<br>', ' ', 'g'), '</?(p|h1|h2|h3|div|ul|li)>') AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM p)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM t"""

#: Components that aren't finite are told by their difference from themselves.
_OP12 = """WITH r AS (SELECT row_number() OVER () AS uid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.uid AS anchor, a.id AS anchor_id, b.uid, b.id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM r a, r b WHERE a.id % 50 = 0 AND a.uid <> b.uid),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, uid) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.id, n.uid) AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor = n.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score QUALIFY rank <= 3"""

ORACLES = {"op4_chat": _OP4, "op7_html": _OP7, "op12_hard_negatives": _OP12}
