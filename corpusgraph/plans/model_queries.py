"""Queries of language-model preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversations as V
from ..operators import packing as P
from ..operators import tasks as K
from ..operators.tables import union_edges
from ..sources import corpus as S
from .registry import query, table

_WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"
_TURNS = """t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, first(role) OVER (PARTITION BY conv_id ORDER BY turn) AS lead_role, first(text) OVER (PARTITION BY conv_id ORDER BY turn) AS lead, count(*) OVER (PARTITION BY conv_id) AS n FROM {0}),
m AS (SELECT conv_id, turn, role, CASE WHEN i = 2 AND lead_role = 'system' THEN concat(lead, chr(10), chr(10), text) ELSE text END AS text FROM t WHERE NOT (i = 1 AND lead_role = 'system' AND n > 1))"""
_FLAT = "f AS (SELECT conv_id, list_concat(['<|bos|>'], flatten(list(list_concat(['<|' || role || '_start|>'], " + _WORDS.format("text") + ", ['<|' || role || '_end|>']) ORDER BY turn))) AS tokens, list_concat([0], flatten(list(list_concat([0], list_transform(" + _WORDS.format("text") + ", lambda w: CASE WHEN role = 'assistant' THEN 1 ELSE 0 END), [CASE WHEN role = 'assistant' THEN 1 ELSE 0 END]) ORDER BY turn))) AS mask FROM m GROUP BY 1)"


@query(f"WITH {_TURNS.format('conversations')}, {_FLAT} SELECT conv_id, array_to_string(tokens[1:300], ' ') AS tokens, array_to_string(list_transform(mask[1:300], lambda x: CAST(x AS VARCHAR)), '') AS mask FROM f")
def render_conversation(spark, sf_dir):
    f = V.flatten(table(spark, sf_dir, "conversations"), 300)
    return f.select("conv_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("mask", "").alias("mask"))


_DROPPED = "d AS (SELECT conv_id, turn, role, text FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, arg_max(role, turn) OVER (PARTITION BY conv_id) AS last_role FROM conversations) WHERE last_role = 'assistant' AND turn < last)"


@query(f"WITH {_DROPPED}, {_TURNS.format('d')}, {_FLAT} SELECT conv_id, concat(array_to_string(tokens[1:2047], ' '), ' <|assistant_start|>') AS tokens FROM f")
def render_for_completion(spark, sf_dir):
    return V.for_completion(table(spark, sf_dir, "conversations")).select("conv_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {_TURNS.format('conversations')}, {_FLAT}, c AS (SELECT conv_id, tokens[1:200] AS tokens, mask[1:200] AS mask FROM f) SELECT conv_id, CAST(len(tokens) - 1 AS INT) AS n, array_to_string(list_transform(range(2, len(tokens) + 1), lambda i: CASE WHEN mask[i] = 1 THEN tokens[i] ELSE '-' END), ' ') AS targets FROM c WHERE len(tokens) > 1")
def shift_targets(spark, sf_dir):
    s = V.shift_targets(V.flatten(table(spark, sf_dir, "conversations"), 200))
    return s.select("conv_id", F.size("inputs").alias("n"), F.array_join("targets", " ", "-").alias("targets"))


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.transform(F.split("text", " "), lambda w: F.length(w) + 1).alias("tokens"))


@query()
def pack_crop(spark, sf_dir):
    """Best fit has no SQL; tests of its own hold its rows."""
    return P.pack(_tokens(spark, sf_dir), 513, marker=0).select("shard", "row", F.size("tokens").alias("n"), F.col("tokens")[0].alias("first"), "parts")


@query()
def pack_pad(spark, sf_dir):
    masked = _tokens(spark, sf_dir).withColumn("mask", F.transform("tokens", lambda x: (x > 3).cast("int")))
    got = P.pack(masked, 513, buffer=100, pad=0, mask="mask")
    return got.select("shard", "row", F.size("tokens").alias("n"), F.size(F.filter("targets", lambda t: t >= 0)).alias("n_targets"), "parts")


@query("""SELECT p_partkey, kind, CAST(unnest([0, 1]) AS INT) AS opt, unnest(prompts) AS prompt FROM (
SELECT p_partkey, 'choices' AS kind, [concat('Q: x', chr(10), 'b', chr(10), chr(10), 'Q: ', p_name, chr(10), p_brand), concat('Q: x', chr(10), 'b', chr(10), chr(10), 'Q: ', p_name, chr(10), p_type)] AS prompts FROM part
UNION ALL SELECT p_partkey, 'schema', [concat('c2 is so', chr(10), chr(10), p_brand, ' ', p_name), concat('c2 is so', chr(10), chr(10), p_type, ' ', p_name)] FROM part
UNION ALL SELECT p_partkey, 'language', [concat('once upon', chr(10), chr(10), p_name), concat('once upon', chr(10), chr(10), p_name, ' ', p_brand)] FROM part)""")
def render_eval(spark, sf_dir):
    """Items of all three types, with an example before each."""
    p = table(spark, sf_dir, "part")
    q = F.array(F.struct(F.lit("Q: x").alias("query"), F.array(F.lit("a"), F.lit("b")).alias("choices"), F.lit(1).alias("gold")))
    s = F.array(F.struct(F.array(F.lit("c1"), F.lit("c2")).alias("context_options"), F.lit("is so").alias("continuation"), F.lit(1).alias("gold")))
    l = F.array(F.struct(F.lit(" once ").alias("context"), F.lit("upon").alias("continuation")))
    made = {
        "choices": P.render_choices_eval(F.concat(F.lit("Q: "), "p_name"), F.array("p_brand", "p_type"), q),
        "schema": P.render_schema_eval(F.array("p_brand", "p_type"), F.col("p_name"), s, " "),
        "language": P.render_language_eval(F.concat("p_name", F.lit(" \n")), F.col("p_brand"), l, " "),
    }
    return p.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("p")) for k, c in made.items()])).alias("e")).select("p_partkey", "e.kind", F.posexplode("e.p").alias("opt", "prompt"))


_T = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


@query(f"""WITH d AS (SELECT doc_id, {_T}[1:40] AS w, lang FROM documents), o AS (SELECT doc_id, list_concat(w, [lang, 'one']) AS a, list_concat(w, [lang, 'two', 'x']) AS b, list_concat(['one'], w) AS c, list_concat(['y', 'two'], w) AS e, w FROM d),
s AS (SELECT doc_id, 'choices' AS kind, 0 AS opt, a AS t, len(w) + 1 AS start FROM o UNION ALL SELECT doc_id, 'choices', 1, b, len(w) + 1 FROM o UNION ALL SELECT doc_id, 'schema', 0, c, 1 FROM o UNION ALL SELECT doc_id, 'schema', 1, e, 2 FROM o UNION ALL SELECT doc_id, 'language', 0, b, len(w) FROM o)
SELECT doc_id, kind, CAST(opt AS INT) AS opt, array_to_string(t[greatest(len(t) - 20, 0) + 1:], ' ') AS tokens, CAST(greatest(start - greatest(len(t) - 20, 0), 0) AS INT) AS start, CAST(least(len(t), 20) AS INT) AS end_ FROM s""")
def answer_spans(spark, sf_dir):
    """Prompts of a document's first words with other ends, other beginnings, and with and without an end."""
    w = F.slice(F.filter(F.split("text", r"\s+"), lambda x: x != ""), 1, 40)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", w.alias("w"))
    more = lambda *x: F.concat("w", F.array(F.col("lang"), *map(F.lit, x)))
    made = {"choices": F.array(more("one"), more("two", "x")), "schema": F.array(F.concat(F.array(F.lit("one")), "w"), F.concat(F.array(F.lit("y"), F.lit("two")), "w")), "language": F.array(F.col("w"), more("two", "x"))}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), P.answer_spans(c, k, 20).alias("s")) for k, c in made.items()])
    got = d.select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.kind", F.posexplode("e.s").alias("opt", "s"))
    return got.select("doc_id", "kind", "opt", F.array_join("s.tokens", " ").alias("tokens"), F.col("s.start").alias("start"), F.col("s.end").alias("end_"))


@query(r"""WITH w AS (SELECT n_nationkey AS rank, lower(n_name) AS word FROM nation), e AS (SELECT doc_id AS id, rank, word, substring(word, CAST(('0x' || substring(md5(concat_ws('|', '42', 'letter', CAST(doc_id AS VARCHAR))), 1, 8))::BIGINT % length(word) AS INT) + 1, 1) AS letter,
('0x' || substring(md5(concat_ws('|', '42', 'template', CAST(doc_id AS VARCHAR))), 1, 8))::BIGINT % 3 AS t FROM documents JOIN w ON ('0x' || substring(md5(concat_ws('|', '42', 'word', CAST(doc_id AS VARCHAR))), 1, 8))::BIGINT % (SELECT count(*) FROM w) = rank)
SELECT id, word, letter, CAST(length(word) - length(replace(word, letter, '')) AS INT) AS n, CASE t WHEN 0 THEN concat('How many ', letter, ' are in ', word, '?') WHEN 1 THEN concat('Count the letter ', letter, ' in ', word, '.') ELSE concat('In how many places does ', letter, ' stand in ', word, '?') END AS question, concat('#### ', CAST(length(word) - length(replace(word, letter, '')) AS VARCHAR)) AS answer FROM e""")
def spelling_examples(spark, sf_dir):
    """An example for each document, of a nation's name."""
    words = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("rank"), F.lower("n_name").alias("word"))
    return P.spelling_examples(words, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


_TOPICS, _OPENERS = {"science": ["atoms", "stars", "cells"], "craft": ["wood", "clay"]}, {"short": ["hi", "hey"], "long": ["good day to you"], "odd": ["so", "well", "hm"], "plain": ["hello"]}
_HASH = "('0x' || substring(md5(concat_ws('|', '42', {0}, CAST(doc_id AS VARCHAR))), 1, 8))::BIGINT % {1}"


@query(f"""WITH d AS (SELECT doc_id, {_HASH.format("'category'", 2)} AS c, {_HASH.format("'persona'", 3)} AS p, {_HASH.format("'dynamic'", 2)} AS y FROM documents),
o AS (SELECT doc_id, k, ['hi', 'hey', 'good day to you', 'so', 'well', 'hm', 'hello'][first + {_HASH.format("k", "n")}] AS said, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat_ws('|', '42', 'order', k, CAST(doc_id AS VARCHAR))), k) AS rn FROM documents, (VALUES ('short', 1, 2), ('long', 3, 1), ('odd', 4, 3), ('plain', 7, 1)) v(k, first, n)),
l AS (SELECT doc_id, string_agg('- ' || said, chr(10) ORDER BY rn) AS openers FROM o WHERE rn <= 3 GROUP BY 1)
SELECT doc_id, CASE c WHEN 0 THEN 'science' ELSE 'craft' END AS category, CASE c WHEN 0 THEN ['atoms', 'stars', 'cells'][1 + {_HASH.format("'topic'", 3)}] ELSE ['wood', 'clay'][1 + {_HASH.format("'topic'", 2)}] END AS topic, ['student', 'nurse', 'cook'][1 + p] AS persona, ['calm', 'brisk'][1 + y] AS dynamic, openers FROM d JOIN l USING (doc_id)""")
def diversity_sample(spark, sf_dir):
    """A sample for each document."""
    return P.diversity_sample(table(spark, sf_dir, "documents"), "doc_id", _TOPICS, {"persona": ["student", "nurse", "cook"], "dynamic": ["calm", "brisk"]}, _OPENERS)


@query("""SELECT id, kind, unnest([0, 1]) AS turn, unnest(['user', 'assistant']) AS role, unnest([asked, said]) AS text FROM (SELECT p_partkey AS id, 'question_answer' AS kind, p_name AS asked, p_brand AS said FROM part
UNION ALL SELECT p_partkey, 'choices', concat('Multiple Choice question: ', p_name, chr(10), '- ', p_brand, '=A', chr(10), '- ', p_type, '=B', chr(10), chr(10), 'Respond only with the letter of the correct answer.'), CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END FROM part
UNION ALL SELECT p_partkey, 'completion', p_name, concat(p_name, chr(10), p_type) FROM part)""")
def to_conversation(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    rows = {
        "question_answer": p.select("id", F.col("p_name").alias("question"), F.col("p_brand").alias("answer")),
        "choices": p.select("id", F.col("p_name").alias("question"), F.array("p_brand", "p_type").alias("choices"), F.array(F.lit("A"), F.lit("B")).alias("letters"), (F.col("id") % 2).cast("int").alias("gold")),
        "completion": p.select("id", F.col("p_name").alias("prompt"), F.col("p_type").alias("solution")),
    }
    return union_edges(*[K.to_conversation(df, kind).select("id", F.lit(kind).alias("kind"), "turn", "role", "text") for kind, df in rows.items()])


@query("""SELECT event_id, 'number' AS kind, event_id % 3 = 0 OR event_id % 3 = 2 OR user_id = 7 AS is_correct FROM events UNION ALL SELECT event_id, 'letter', event_type = 'click' FROM events""")
def evaluate_answers(spark, sf_dir):
    """Equal numbers, a number against 7, and two answers without one, which counts as equal; and letters."""
    k, n = F.col("event_id") % 3, F.col("user_id").cast("string")
    e = table(spark, sf_dir, "events")
    number = e.select("event_id", F.when(k == 0, F.concat(F.lit("so\n#### "), n)).when(k == 1, "#### 7").otherwise("none").alias("reference"), F.when(k < 2, F.concat(F.lit("#### "), n)).otherwise("nor here").alias("answer"))
    letter = e.select("event_id", F.lit("click").alias("reference"), F.col("event_type").alias("answer"))
    return union_edges(*[K.evaluate_answers(df, kind).select("event_id", F.lit(kind).alias("kind"), "is_correct") for kind, df in (("number", number), ("letter", letter))])


@query("SELECT doc_id, line AS text, CAST(CASE WHEN line IS NULL THEN 3 ELSE 1 END AS INT) AS attempts, CASE WHEN line IS NULL THEN 'empty response' END AS error FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1] END AS line FROM documents)")
def respond(spark, sf_dir):
    """The last line of each document by the responder without a model; a tenth of the prompts are empty."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("text")).otherwise("  ").alias("prompt"))
    return K.respond(d, "prompt", retries=2).select("doc_id", "response.*")


@query("SELECT (p_partkey - 1 - 5) // 2 AS idx, concat('#### ', CAST(p_size AS VARCHAR)) AS answer, p_size % 2 = 0 OR p_size = 1 AS is_correct FROM part WHERE p_partkey - 1 >= 5 AND (p_partkey - 1 - 5) % 2 = 0")
def run_task(spark, sf_dir):
    """A sliced task whose prompts end with an answer, right for even sizes."""
    answer = F.concat(F.lit("#### "), F.col("p_size").cast("string"))
    items = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("idx"), F.concat(F.lit("What size?\n"), answer).alias("prompt"), F.when(F.col("p_size") % 2 == 0, answer).otherwise("#### 1").alias("reference"))
    return K.Task(items, "number", 5, None, 2).run().select("idx", "answer", "is_correct")


@query("""WITH m AS (SELECT event_id, ['<|bos|>', '<|user_start|>', 'Add', event_type, '<|user_end|>', '<|assistant_start|>', 'Sum', '<|python_start|>', 'a=1+2', '<|python_end|>', '<|output_start|>', '3', '<|output_end|>', 'done', '<|assistant_end|>'] AS t FROM events)
SELECT event_id AS conv_id, array_to_string(t, ' ') AS tokens, '000000111100011' AS mask FROM m""")
def render_tool_calls(spark, sf_dir):
    """Answers that call a tool: the call counts, its output doesn't."""
    e = table(spark, sf_dir, "events")
    user = F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("Add "), "event_type").alias("text"), T.tool_calls(F.lit(None).cast("string")).alias("parts"))
    ours = F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.lit("").alias("text"), T.tool_calls(F.lit("Sum <<a=1+2=3>> done")).alias("parts"))
    turns = e.select(F.col("event_id").alias("conv_id"), F.inline(F.array(user, ours)))
    return V.flatten(turns).select("conv_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("mask", "").alias("mask"))


@query()
def shard_plan(spark, sf_dir):
    """Which shard each document goes to, and its place there."""
    return S.shard_rows(table(spark, sf_dir, "documents"), "doc_id", "text", 200_000, 16).select("doc_id", "shard", "place")


