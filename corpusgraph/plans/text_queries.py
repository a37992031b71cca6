"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables as O
from .fixtures import PAPERS, papers
from .registry import query, table

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, {_strip(chr(114) + 'egexp_replace(regexp_replace(text, ' + chr(39) + '[ ' + chr(92) + 't]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + chr(92) + 'n{3,}' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + ')')} AS clean FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("clean"))


@query(rf"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE {_strip("regexp_replace(substr(text, 1, 200), ' [^ ]*$', '')")} END AS cut FROM documents")
def truncate_chars(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.truncate_chars(F.col("text"), 200).alias("cut"))


@query(f"SELECT doc_id, CASE WHEN len({_words('text')}) <= 50 THEN {_strip('text')} ELSE array_to_string({_words('text')}[1:50], ' ') END AS cut FROM documents")
def truncate_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.truncate_words(F.col("text"), 50).alias("cut"))


@query(f"SELECT doc_id, CAST(len({_words('text')}) AS BIGINT) AS n_words, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def text_sizes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n_words"), T.token_estimate(F.col("text")).alias("tokens"))


_BLOCKS = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n'), lambda p: regexp_replace(regexp_replace(p, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda p: p <> '')"


@query(f"SELECT doc_id, CAST(len(b) AS BIGINT) AS n_paragraphs, b[1] AS first_paragraph, CAST(len(list_filter(b, lambda p: regexp_matches(lower(p), '^\\s*(\\[\\d+\\]|\\d+\\.\\s)|doi:|arxiv:'))) AS BIGINT) AS n_references FROM (SELECT doc_id, {_BLOCKS} AS b FROM documents)")
def paragraphs(spark, sf_dir):
    """Documents have one line feed between paragraphs, so each is doubled first."""
    p = _docs(spark, sf_dir).select("doc_id", T.paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n_paragraphs"), F.get("p", F.lit(0)).alias("first_paragraph"), F.size(F.filter("p", T.is_reference_paragraph)).cast("long").alias("n_references"))


#: A document with headings of all kinds around its whole text, as SQL of both engines.
_HEADED = """concat('1. Introduction', {nl}, text, CASE doc_id % 6 WHEN 0 THEN concat({nl}, '5. Conclusion', {nl}) WHEN 1 THEN concat({nl}, '2.1 concluding remarks ', {nl}) WHEN 2 THEN concat({nl}, 'Summary and Discussion', {nl}) WHEN 3 THEN concat({nl}, 'Outlook', {nl})
 WHEN 4 THEN concat({nl}, 'Summary and Discussion', {nl}, lang, {nl}, 'CONCLUSION', {nl}) ELSE concat({nl}, 'Conclusion', {nl}, 'References', {nl}) END, replace(text, {nl}, concat({nl}, {nl})), ' $x', lang, '$', {nl}, {nl}, '[7] A reference, doi:10.1/', source, ', that is long enough to be kept otherwise, as it has over ten words.', {nl}, {nl}, text, {nl},
 CASE doc_id % 4 WHEN 0 THEN 'Acknowledgments' WHEN 1 THEN '7 Supplementary Material' WHEN 2 THEN 'appendix' ELSE 'References' END, {nl}, 'nothing of this belongs to it, whatever its length may be, and so on and on', {nl})"""


def _headed(spark, sf_dir):
    return spark.sql(f"SELECT doc_id, {_HEADED.format(nl="'\\n'")} AS body FROM {{docs}}", docs=_docs(spark, sf_dir))


def _heading_sql(*patterns: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(body, '(?i){p}') THEN regexp_extract(body, '(?is){p}(.*)', 1)" for p in patterns) + " END"


_H = r"\n(?:[0-9.]*\s*)?"


def _stop_sql(*stops: str) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches(after, '(?i){_H}{p}') AND length(regexp_extract(after, '(?is)^(.*?){_H}{p}', 1)) > 50 THEN length(regexp_extract(after, '(?is)^(.*?){_H}{p}', 1)) END" for p in stops)
    return f"regexp_replace(substr(after, 1, least({found}, length(after))), '\\$[^\\n]*?\\$', '', 'g')"


_CONCLUSION = rf"""WITH d AS (SELECT doc_id, {_HEADED.format(nl="chr(10)")} AS body FROM documents),
h AS (SELECT doc_id, {_heading_sql(_H + 'Conclusion\\b', _H + 'Concluding Remarks\\b', _H + 'Summary and Discussion\\b')} AS after FROM d),
b AS (SELECT doc_id, after, list_filter(list_transform(string_split_regex(regexp_replace({_stop_sql('References\\b', 'Bibliography\\b', 'Appendix\\b', 'Acknowledg?ments?\\b', 'Supplementary Material\\b')}, '\r\n?', chr(10), 'g'), '\n\s*\n'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '') AS ps FROM h),
u AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM b),
g AS (SELECT doc_id, i, p, len(list_filter(string_split_regex(p, '\s+'), lambda w: w <> '')) AS n FROM u WHERE length(p) >= 60 AND NOT regexp_matches(lower(p), '^(\[\d+\]|\d+\.\s)|doi:|arxiv:')),
r AS (SELECT *, row_number() OVER w AS rn, sum(n) OVER w AS run FROM g WHERE n >= 10 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS kept FROM r WHERE rn <= 6 AND run <= 500 GROUP BY 1),
f AS (SELECT doc_id, after, kept, array_to_string(ps, ' ') AS flat FROM b LEFT JOIN k USING (doc_id))
SELECT doc_id, CASE WHEN after IS NULL THEN '' WHEN kept IS NOT NULL THEN kept WHEN length(flat) <= 1800 THEN flat ELSE trim(regexp_replace(substr(flat, 1, 1800), ' [^ ]*$', '')) END AS conclusion FROM f"""


@query(_CONCLUSION)
def extract_conclusion(spark, sf_dir):
    return _headed(spark, sf_dir).select("doc_id", T.extract_conclusion(F.col("body")).alias("conclusion"))


@query(rf"""WITH d AS (SELECT doc_id, replace(replace({_HEADED.format(nl="chr(10)")}, 'onclusion', CASE WHEN doc_id % 2 = 0 THEN 'onclusion' ELSE 'onclude' END), 'ONCLUSION', 'ONCLUDE') AS body FROM documents),
h AS (SELECT doc_id, CASE WHEN regexp_matches(body, '(?i)Conclusion') THEN regexp_extract(body, '(?is)Conclusion.*') WHEN regexp_matches(body, '(?i){_H}Concluding Remarks') THEN regexp_extract(body, '(?is){_H}Concluding Remarks.*') WHEN regexp_matches(body, '(?i){_H}Summary and Discussion') THEN regexp_extract(body, '(?is){_H}Summary and Discussion.*') END AS after FROM d)
SELECT doc_id, CASE WHEN after IS NOT NULL THEN trim(regexp_replace({_stop_sql('References', 'Bibliography', 'Appendix', 'Acknowledgments', 'Supplementary Material')}, '\s+', ' ', 'g')) END AS conclusion FROM h""")
def extract_conclusion_simple(spark, sf_dir):
    other = F.when(F.col("doc_id") % 2 == 0, "onclusion").otherwise("onclude")
    body = F.replace(F.replace("body", F.lit("onclusion"), other), F.lit("ONCLUSION"), F.lit("ONCLUDE"))
    return _headed(spark, sf_dir).select("doc_id", T.extract_conclusion_simple(body).alias("conclusion"))


_LISTED = "concat(text, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE concat({nl}, CASE WHEN doc_id % 3 = 1 THEN 'REFERENCES' ELSE 'references' END, {nl}) END, '[1] ', source, ' wrote [sic]', {nl}, ' about ', lang, ' in 2001 [2]', source, '[3]  ', text, {nl}, '[12] doi:10.1/', doc_id, ' and so on [13]')"


@query(rf"""WITH d AS (SELECT doc_id, {_LISTED.format(nl="chr(10)")} AS body FROM documents), f AS (SELECT doc_id, regexp_replace(CASE WHEN regexp_matches(body, '(?i)references') THEN regexp_extract(body, '(?is)references.*') ELSE body END, '\s+', ' ', 'g') AS flat FROM d),
l AS (SELECT doc_id, list_filter(list_transform(list_zip(regexp_extract_all(flat, '\[\d+\]'), string_split_regex(flat, '\[\d+\]')[2:]), lambda z: concat(z[1], ' ', trim(z[2]))), lambda e: length(e) > 15) AS l FROM f)
SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS entry FROM l""")
def split_references(spark, sf_dir):
    body = spark.sql(f"SELECT doc_id, {_LISTED.format(nl="'\\n'")} AS body FROM {{docs}}", docs=_docs(spark, sf_dir))
    got = body.select("doc_id", F.posexplode(T.split_references(F.col("body"))).alias("pos", "entry"))
    return got.withColumn("pos", F.col("pos").cast("long"))


@query(rf"""WITH p AS (SELECT doc_id AS id, i AS page, CASE WHEN i % 7 = 3 THEN '' ELSE trim(regexp_replace(regexp_replace(regexp_replace(concat(text, ' ', i), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) END AS t FROM documents, (SELECT unnest(range(90)) AS i) WHERE i < 80),
s AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE length(t) + 2 END AS size, sum(CASE WHEN t = '' THEN 0 ELSE length(t) + 2 END) OVER (PARTITION BY id ORDER BY page) AS upto FROM p),
o AS (SELECT *, min(CASE WHEN upto > 350000 AND size > 0 THEN page END) OVER (PARTITION BY id) AS stop FROM s),
k AS (SELECT *, CASE WHEN stop IS NULL OR page < stop THEN t WHEN page = stop AND 350000 - (upto - size) > 200 THEN CASE WHEN length(t) <= 350000 - (upto - size) THEN t ELSE trim(regexp_replace(substr(t, 1, CAST(350000 - (upto - size) AS BIGINT)), ' [^ ]*$', '')) END END AS kept FROM o)
SELECT id, md5(coalesce(string_agg(nullif(kept, ''), chr(10) || chr(10) ORDER BY page), '')) AS digest, CASE WHEN count(nullif(kept, '')) > 0 THEN 'pdf' ELSE 'empty_pdf' END AS source, any_value(stop) IS NOT NULL AS truncated, count(*) FILTER (stop IS NULL OR page < stop) AS pages_processed FROM k GROUP BY 1""")
def assemble_pages(spark, sf_dir):
    placed = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")  # a text moves once, not with each page
    pages = placed.select("id", "text", F.explode(F.sequence(F.lit(0), F.lit(89))).alias("page"))
    pages = pages.select("id", "page", F.when(F.col("page") % 7 == 3, "  ").otherwise(F.concat("text", F.lit(" "), F.col("page").cast("string"))).alias("t"))
    return T.assemble_pages(pages, "id", "page", "t").select("id", F.md5("full_text").alias("digest"), "source", "truncated", "pages_processed")


@query(r"SELECT doc_id, 2 AS n_entries, 'Cited work number one of ' || source || ', in a journal' AS first_entry FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 0, NULL FROM documents WHERE doc_id % 2 = 1")
def split_references_block(spark, sf_dir):
    body = F.concat(F.lit("Body\n"), F.when(F.col("doc_id") % 2 == 0, "References").otherwise("Notes"), F.lit("\n[1] Cited work number one of "), "source", F.lit(",\nin a journal\n2. A second cited work with its own long title\n3 short\nAppendix\n[4] not a reference, though it is long enough for one"))
    got = _docs(spark, sf_dir).select("doc_id", T.split_references_block(body, 10).alias("e"))
    return got.select("doc_id", F.size("e").alias("n_entries"), F.get("e", F.lit(0)).alias("first_entry"))


@query("SELECT doc_id, concat(CAST(2000 + doc_id % 400 AS VARCHAR), '.', CAST(10000 + doc_id AS VARCHAR)) AS paper_id, CASE WHEN doc_id % 2 = 0 THEN concat(CAST(2000 + doc_id % 400 AS VARCHAR), '.', CAST(10000 + doc_id AS VARCHAR)) END AS bounded FROM documents")
def extract_paper_id(spark, sf_dir):
    n = F.concat((2000 + F.col("doc_id") % 400).cast("string"), F.lit("."), (10000 + F.col("doc_id")).cast("string"))
    return _docs(spark, sf_dir).select("doc_id", T.extract_paper_id(F.concat(F.lit("https://arxiv.org/abs/"), n, F.lit("v2"))).alias("paper_id"), T.extract_paper_id(F.concat(F.when(F.col("doc_id") % 2 == 0, "id ").otherwise("id7"), n, F.lit("v1")), True).alias("bounded"))


@query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS BIGINT) AS n_tokens, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(substr(text, 1, 80)), '[a-z0-9]{3,}'))), ' ') AS head FROM documents")
def keyword_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.keyword_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.array_join(F.array_sort(T.keyword_tokens(F.substring("text", 1, 80))), " ").alias("head"))


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, s[1] AS first, s[-1] AS last, list_filter(s, lambda x: contains(lower(x), 'tion') OR contains(lower(x), 'ing'))[1] AS hit FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents)")
def sentences(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(T.sentences(t)).cast("long").alias("n_sentences"), T.first_sentence(t).alias("first"), T.last_sentence(t).alias("last"), T.sentence_with(t, ["tion", "ing"]).alias("hit"))


def _part(name: str, label: str = "") -> str:
    return f"nullif('{label}' || {_strip(name)}, '{label}')"


@query(f"""WITH {PAPERS} SELECT id, nullif(concat_ws(chr(10) || chr(10), {_part('title', 'Title: ')}, {_part('abstract', 'Abstract: ')}), '') AS labelled,
nullif(concat_ws(chr(10) || chr(10), {_part('title')}, {_part('abstract')}, {_part('tldr')}), '') AS with_tldr, nullif(concat_ws(chr(10) || chr(10), {_part('title')}, {_part('abstract')}, {_part('conclusion')}), '') AS with_conclusion, {_part('tldr')} AS tldr_only FROM papers""")
def compose_text(spark, sf_dir):
    return papers(spark, sf_dir).select("id", T.compose_text().alias("labelled"), T.compose_text("title_abstract_tldr").alias("with_tldr"), T.compose_text("title_abstract_conclusion").alias("with_conclusion"), T.compose_text("tldr_only").alias("tldr_only"))


@query("""SELECT c_custkey AS id, CASE WHEN n = 0 THEN 'Unknown' ELSE concat(array_to_string(list_filter(list_transform(range(least(n, 5)), lambda i: CASE WHEN i = 2 THEN '' ELSE concat(c_name, '-', CAST(i AS VARCHAR)) END), lambda x: x <> ''), ', '), CASE WHEN n > 5 THEN ' et al.' ELSE '' END) END AS authors,
coalesce(CASE WHEN c_custkey % 3 = 0 THEN 2000 + CAST(c_nationkey AS INT) END, 1990 + CAST(c_custkey % 10 AS INT)) AS year FROM (SELECT *, CAST(c_custkey % 8 AS INT) AS n FROM customer)""")
def author_display(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("n", (F.col("c_custkey") % 8).cast("int"))
    names = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i == 2, "").otherwise(F.concat("c_name", F.lit("-"), i.cast("string")))))
    year = T.year_of(F.when(F.col("c_custkey") % 3 == 0, (2000 + F.col("c_nationkey")).cast("string")), F.concat((1990 + F.col("c_custkey") % 10).cast("string"), F.lit("-05-01")))
    return c.select(F.col("c_custkey").alias("id"), T.author_display(names).alias("authors"), year.alias("year"))


@query(f"WITH {PAPERS} SELECT id, substr(coalesce(nullif({_strip('t')}, ''), 'Untitled'), 1, 40) AS label, substr(coalesce(nullif({_strip('t')}, ''), 'Untitled'), 1, 20) AS short FROM (SELECT id, CASE WHEN id % 9 = 0 THEN ' ' ELSE title END AS t FROM papers)")
def title_labels(spark, sf_dir):
    t = F.when(F.col("id") % 9 == 0, " ").otherwise(F.col("title"))
    return papers(spark, sf_dir).select("id", T.node_label(t).alias("label"), T.short_title(t).alias("short"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat_ws(',', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR)) END AS ids, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS n_first FROM events""")
def json_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 8 == 0, "not json").when(F.col("event_id") % 8 == 4, F.lit(None).cast("string")).otherwise(F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(", null, \"x\", \""), F.col("user_id").cast("string"), F.lit("\"]")))
    return e.select("event_id", F.array_join(T.json_ids(raw), ",").alias("ids"), F.size(T.json_ids(raw, 1)).alias("n_first"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'SUPPORT' WHEN 'view' THEN 'CONTRADICT' ELSE 'NEUTRAL' END AS label, concat('it is a ', event_type) AS reason, event_type AS name, 'none' AS description FROM events""")
def parse_responses(spark, sf_dir):
    """Labels, reasons, names and descriptions from responses, of which some repeat a line or lack one."""
    said = F.when(F.col("event_type") == "click", "LABEL: neutral\nLABEL: Support").when(F.col("event_type") == "view", "label: they CONTRADICT").otherwise("no label")
    c = F.concat(said, F.lit("\nREASON:  it is a "), "event_type", F.lit(" \nNAME: \""), "event_type", F.lit("\"\nDESCRIPTION: ''"))
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.parse_label(c).alias("label"), T.parse_reason(c).alias("reason"), T.parse_name(c, "NAME", F.lit("?")).alias("name"), T.parse_name(c, "DESCRIPTION", F.lit("none")).alias("description"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 5 = 4 THEN NULL ELSE user_id END AS user_id FROM events")
def recover_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    j = F.to_json(F.struct(F.col("event_type").alias("kind"), "user_id"))
    k = F.col("event_id") % 5
    raw = F.when(k == 0, j).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), j, F.lit("\n```\nDone"))).when(k == 2, F.concat(F.lit("```\n"), j, F.lit("\n```"))).when(k == 3, F.concat(F.lit("It is "), j, F.lit(" as asked"))).otherwise("nothing here")
    got = e.select("event_id", T.recover_json(raw, "kind string, user_id long").alias("o"))
    return got.select("event_id", "o.kind", "o.user_id")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS research_question, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type ELSE concat_ws('|', event_type, 'x') END AS methods, event_id % 3 = 0 AND event_id % 4 = 0 AS is_empty, CAST((event_id % 3 <> 0) AS INT) + CAST((event_id % 4 <> 0) AS INT) AS populated FROM events""")
def normalize_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    methods = F.when(k == 1, F.col("event_type")).when(k == 2, F.concat(F.lit('["'), "event_type", F.lit('", " ", "x", null]')))
    asked = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit(" "), "event_type", F.lit("\n")))
    got = T.normalize_summary(e.select("event_id", methods.alias("methods"), asked.alias("research_question"), F.lit(" ").alias("limitations"))).select("event_id", "summary.*", "is_empty", "populated")
    return got.select("event_id", "research_question", F.array_join("methods", "|").alias("methods"), "is_empty", "populated")


@query("SELECT event_id, concat_ws(',', CAST(user_id AS VARCHAR), CASE WHEN event_id % 2 = 0 OR event_id = user_id THEN CAST(event_id AS VARCHAR) END, CAST(user_id AS VARCHAR)) AS cited FROM events")
def valid_citations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cited = F.array(F.col("user_id").cast("string"), F.lit("bad"), F.col("event_id").cast("string"), F.lit("-5"), F.col("user_id").cast("string"))
    known = F.when(F.col("event_id") % 2 == 0, F.array("user_id", "event_id")).otherwise(F.array("user_id"))
    return e.select("event_id", F.array_join(T.valid_citations(cited, known), ",").alias("cited"))


@query(f"""SELECT conv_id, turn, q <> '' AND (len({_words('q')}) <= 8 OR len(list_intersect({_words('q')}, ['it', 'they', 'this', 'that', 'these', 'those', 'he', 'she'])) > 0) AS ambiguous,
regexp_matches(q, 'weather|restaurant|movie|stock|sports|recipe|vacation|dating|politics|bitcoin') AS unrelated FROM (SELECT conv_id, turn, lower({_strip("coalesce(text, '')")}) AS q FROM conversations)""")
def question_flags(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.ambiguous_question(F.col("text")).alias("ambiguous"), T.unrelated_question(F.col("text")).alias("unrelated"))


_SUMMARY = "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN concat('So: Key contributions advance the understanding of ML. ', lang) WHEN 2 THEN concat('An ml method with ml and ml parts. ', text) WHEN 3 THEN concat('ML ', text, ' and ML') WHEN 4 THEN concat('ml ', text) WHEN 5 THEN concat(text, ' of ml ml ml ') ELSE text END"


@query(f"""WITH s AS (SELECT doc_id, lower({_strip(_SUMMARY)}) AS s, lower(concat(source, ' ', coalesce(text, ''))) AS about FROM documents)
SELECT doc_id, s = '' OR contains(s, 'how can ml techniques be applied to improve state-of-the-art results?') OR contains(s, 'the paper presents novel approaches within the ml domain.') OR contains(s, 'key contributions advance the understanding of ml.') OR contains(s, 'this work provides meaningful progress in ml research.')
OR ((length(s) - length(replace(s, ' ml ', ''))) / 4 + CAST(starts_with(s, 'ml ') AS INT) + CAST(ends_with(s, ' ml') AS INT) >= 2 AND NOT regexp_matches(about, 'machine learning|deep learning|transformer|neural|language model|llm|ml')) AS low FROM s""")
def low_quality_summary(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.low_quality_summary(F.expr(_SUMMARY), F.col("source"), F.col("text")).alias("low"))


def _first_with(words: str) -> str:
    return f"list_filter(s, lambda x: regexp_matches(lower(x), '{words}'))[1]"


@query(f"""WITH {PAPERS}, p AS (SELECT id, {_strip("coalesce(abstract, '')")} AS a, {_strip("coalesce(tldr, '')")} AS t, {_strip("coalesce(conclusion, '')")} AS c FROM papers),
s AS (SELECT *, {_SENTENCES.format("array_to_string(list_filter([a, t, c], lambda x: x <> ''), chr(10))")} AS s, {_SENTENCES.format('a')} AS sa, {_SENTENCES.format('t')} AS st FROM p)
SELECT id, coalesce({_first_with('investigate|study|examine|analyze|measure|what|whether')}, sa[1]) AS research_question, coalesce({_first_with('method|approach|analysis|experiment|dataset|model|using|fit|estimate')}, '') AS methods,
coalesce({_first_with('find|result|show|observe|improv|constrain|evidence|demonstrate')}, st[1], '') AS key_findings, coalesce(nullif(t, ''), nullif(c, ''), sa[-1]) AS conclusion FROM s""")
def derive_summary(spark, sf_dir):
    return T.derive_summary(papers(spark, sf_dir)).select("id", "research_question", F.array_join("methods", "|").alias("methods"), F.array_join("key_findings", "|").alias("key_findings"), "conclusion")


@query(f"""WITH c AS (SELECT conv_id, {_strip("string_agg(" + _strip("coalesce(CASE WHEN conv_id % 5 > 0 THEN text END, '')") + ", ' ' ORDER BY turn)")} AS t FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN t = '' THEN 'I couldn''t find enough indexed context for this paper yet. Try again in a minute after chunking completes.' ELSE 'Based on the paper text I can access: ' || array_to_string(({_SENTENCES.format('t')})[1:2], ' ') END AS answer FROM c""")
def fallback_answer(spark, sf_dir):
    """Turns stand for a paper's chunks."""
    said = F.struct("turn", F.when(F.col("conv_id") % 5 > 0, F.col("text")).alias("text"))
    chunks = F.transform(F.sort_array(F.collect_list(said)), lambda x: x["text"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(chunks.alias("chunks")).select("conv_id", T.fallback_answer(F.col("chunks")).alias("answer"))


_CONTEXT = "array_to_string(list_filter([CASE WHEN a <> '' THEN '[Chunk ID: 1 | Type: abstract]' || chr(10) || a END, CASE WHEN c <> '' THEN '[Chunk ID: 2 | Type: body]' || chr(10) || c END], lambda x: x IS NOT NULL), chr(10) || chr(10))"


@query(f"""WITH {PAPERS}, p AS (SELECT id, title, {_strip("coalesce(abstract, '')")} AS a, {_strip("coalesce(conclusion, '')")} AS c, coalesce(abstract, '') AS abstract, CASE WHEN id % 2 = 0 THEN 'USER: why' ELSE '' END AS history FROM papers)
SELECT id, {_CONTEXT} AS context, concat('TITLE: ', title, chr(10), chr(10), 'PAPER CONTENT:', chr(10), chr(10), chr(10), '[Chunk 1 | ID: 1 | Type: abstract]:', chr(10), abstract) AS summary,
concat('Answer from these chunks alone and cite the ids that support the answer, as JSON with answer and cited_chunk_ids.', chr(10), 'VALID CHUNK IDS: [1,2]', CASE WHEN history <> '' THEN chr(10) || 'RECENT CONVERSATION:' || chr(10) || history ELSE '' END, chr(10), 'QUESTION:', chr(10), 'what is new?', chr(10), 'RETRIEVED PAPER CHUNKS:', chr(10), {_CONTEXT}) AS grounded,
concat('Write the follow-up question so that it stands alone, from the conversation alone.', chr(10), 'CONVERSATION HISTORY:', chr(10), history, chr(10), 'FOLLOW-UP QUESTION:', chr(10), 'what is new?') AS rewrite,
concat('Answer from the title and the abstract alone.', chr(10), 'TITLE:', chr(10), title, chr(10), 'ABSTRACT:', chr(10), abstract, chr(10), 'QUESTION:', chr(10), 'what is new?') AS abstract_only,
concat('Answer from the retrieved chunks alone.', chr(10), 'TITLE:', chr(10), title, chr(10), 'QUESTION:', chr(10), 'what is new?', chr(10), 'RETRIEVED CHUNKS:', chr(10), {_CONTEXT}) AS retrieval FROM p""")
def build_prompts(spark, sf_dir):
    """A prompt of each kind for every paper."""
    chunk = lambda i, kind, c: F.struct(F.lit(i).alias("chunk_id"), F.lit(kind).cast("string").alias("chunk_type"), F.coalesce(c, F.lit("")).alias("chunk_text"))
    p = papers(spark, sf_dir).select("id", "title", F.coalesce("abstract", F.lit("")).alias("abstract"), F.array(chunk(1, "abstract", F.col("abstract")), chunk(2, None, F.col("conclusion"))).alias("chunks"), F.when(F.col("id") % 2 == 0, "USER: why").otherwise("").alias("history"), F.lit("what is new?").alias("question"))
    p = p.withColumn("context", T.chunk_context(F.col("chunks"))).withColumn("chunk_ids", F.to_json(F.transform("chunks", lambda c: c["chunk_id"])))
    p = p.withColumn("summary", T.summary_context(F.col("title"), F.slice("chunks", 1, 1)))
    for kind in T.PROMPTS:
        p = T.build_prompts(p, kind)
    return p.select("id", "context", "summary", *T.PROMPTS)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id * 1000 AS VARCHAR) END AS strict, CASE event_id % 3 WHEN 0 THEN CAST(event_id * 1000 AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) ELSE 'N/A' END AS lenient,
CASE WHEN event_id % 3 = 0 THEN true ELSE event_id % 2 = 0 END AS same FROM events""")
def extract_answer(spark, sf_dir):
    """Answers by both rules, and their comparison with a reference: both missing counts as equal."""
    k = F.col("event_id") % 3
    c = F.when(k == 0, F.concat(F.lit("so 12 it is\n#### "), F.col("event_id").cast("string"), F.lit(",000"))).when(k == 1, F.concat(F.lit("first 3, then "), F.col("user_id").cast("string"))).otherwise("none")
    c = F.when((k == 0) & (F.col("event_id") == 0), "so 12\n#### 0").otherwise(c)
    reference = F.when(k == 0, (F.col("event_id") * 1000).cast("string")).when(F.col("event_id") % 2 == 1, "7")
    return table(spark, sf_dir, "events").select("event_id", T.extract_answer(c).alias("strict"), T.extract_answer(c, "lenient").alias("lenient"), T.extract_answer(c).eqNullSafe(reference).alias("same"))


@query("""SELECT event_id, CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS pos, unnest(['text', 'python', 'python_output', 'text']) AS kind, unnest([concat('Add ', event_type, ' '), concat('a=', CAST(user_id AS VARCHAR), '*2'), CAST(user_id * 2 AS VARCHAR), ' done']) AS part FROM events""")
def tool_calls(spark, sf_dir):
    u = F.col("user_id")
    c = F.concat(F.lit("Add "), "event_type", F.lit(" <<a="), u.cast("string"), F.lit("*2="), (u * 2).cast("string"), F.lit(">> done"))
    got = table(spark, sf_dir, "events").select("event_id", F.posexplode(T.tool_calls(c)).alias("pos", "p"))
    return got.select("event_id", F.col("pos").cast("long").alias("pos"), F.col("p.type").alias("kind"), F.col("p.text").alias("part"))


@query("SELECT event_id, concat('x = ', CAST(user_id AS VARCHAR)) AS program, 'import os' || chr(10) || 'from sys import path' AS imports FROM events")
def extract_program(spark, sf_dir):
    body = F.concat(F.lit("x = "), F.col("user_id").cast("string"))
    c = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```python\n"), body, F.lit("\n```\nbye"))).otherwise(F.concat(F.lit("\n"), body, F.lit("\n ")))
    i = F.concat(F.lit("# head\nimport os\n\nfrom sys import path\n"), body, F.lit("\nimport late"))
    return table(spark, sf_dir, "events").select("event_id", T.extract_program(c).alias("program"), T.extract_imports(i).alias("imports"))


#: A question's category, by {0}.
_CASES = r"""CASE WHEN regexp_matches({0}, 'dollar|money|\$|price|cost') THEN 'money' WHEN regexp_matches({0}, 'hour|minute|day|week|month|schedule|time') THEN 'time_scheduling' WHEN regexp_matches({0}, 'total|sum|together') THEN 'arithmetic'
WHEN regexp_matches({0}, 'each|every|per') THEN 'multiplication' WHEN regexp_matches({0}, 'left|remain|after') THEN 'subtraction' WHEN regexp_matches({0}, 'split|share|divided') THEN 'division' WHEN regexp_matches({0}, 'percent|%|percentage') THEN 'percentage'
WHEN regexp_matches({0}, 'long|short|width|height|area|perimeter|volume|meter|inch|cm') THEN 'geometry_measurement' WHEN regexp_matches({0}, 'larger|smaller|more than|less than|compare') THEN 'comparison' ELSE 'multi_step' END"""
#: Questions of all kinds: a document's sentences, one by one.
_ASKED = f"SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS t FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents)"


def _asked(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "t"))


@query(f"SELECT doc_id, CAST(i AS INT) AS i, {_CASES.format('lower(t)')} AS category FROM ({_ASKED}) UNION ALL SELECT conv_id, -1 - CAST(turn AS INT), {_CASES.format('lower(text)')} FROM conversations")
def categorize(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (-1 - F.col("turn").cast("int")).alias("i"), F.col("text").alias("t"))
    return _asked(spark, sf_dir).unionByName(turns).select("doc_id", "i", T.categorize(F.col("t")).alias("category"))


@query("SELECT p_partkey, concat('Multiple Choice question: Which is ', p_name, '?', chr(10), '- ', p_brand, '=A', chr(10), '- ', p_type, '=B', chr(10), chr(10), 'Respond only with the letter of the correct answer.') AS prompt FROM part")
def render_choices(spark, sf_dir):
    q = F.concat(F.lit("Which is "), "p_name", F.lit("?"))
    return table(spark, sf_dir, "part").select("p_partkey", T.render_choices(q, F.array("p_brand", "p_type"), F.array(F.lit("A"), F.lit("B"))).alias("prompt"))


@query()
def pretokens(spark, sf_dir):
    got = _docs(spark, sf_dir).select("doc_id", T.pretokens(F.col("text")).alias("p"), "text")
    return got.select("doc_id", F.size("p").alias("n_pretokens"), (F.array_join("p", "") == F.col("text")).alias("whole"))


@query("SELECT doc_id, substr(text, 1, 500) AS head FROM documents")
def crop(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.crop(F.col("text"), 500).alias("head"))


@query("""SELECT p_partkey, CAST(pos AS BIGINT) AS pos, title, year, arxiv_id, doi, ss_paper_id FROM (
SELECT p_partkey, 0 AS pos, p_name AS title, p_size AS year, NULL AS arxiv_id, p_brand AS doi, 'a' AS ss_paper_id FROM part
UNION ALL SELECT p_partkey, 1, p_type, NULL, p_brand, NULL, 'b' FROM part)""")
def connections(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    direct = F.to_json(F.struct(F.lit("a").alias("paperId"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.struct(F.col("p_brand").alias("DOI")).alias("externalIds")))
    wrapped = F.to_json(F.struct(F.struct(F.lit("b").alias("paperId"), F.col("p_type").alias("title"), F.struct(F.col("p_brand").alias("ArXiv")).alias("externalIds")).alias("citedPaper")))
    raw = F.concat(F.lit("["), direct, F.lit(","), wrapped, F.lit(","), wrapped, F.lit("]"))
    got = p.select("p_partkey", F.posexplode(T.connections(raw, 2)).alias("pos", "e"))
    return got.select("p_partkey", F.col("pos").cast("long").alias("pos"), "e.*")


@query(f"""WITH {PAPERS} SELECT id, CASE WHEN id % 2 = 0 THEN 'api' WHEN id % 3 = 0 THEN 'pdf' ELSE 'none' END AS origin, CASE WHEN id % 2 = 0 THEN concat(title, '|', lang) WHEN id % 3 = 0 THEN title ELSE '' END AS entries, coalesce(nullif(conclusion, ''), tldr) AS conclusion FROM papers""")
def coalesce_sources(spark, sf_dir):
    none = F.expr("cast(array() as array<string>)")
    api, pdf = F.when(F.col("id") % 2 == 0, F.array("title", "lang")).when(F.col("id") % 5 == 0, none), F.when(F.col("id") % 3 == 0, F.array("title"))
    return T.coalesce_sources(papers(spark, sf_dir).withColumn("api", api).withColumn("pdf", pdf), {"api": "api", "pdf": "pdf"}).select("id", "origin", F.array_join("entries", "|").alias("entries"), "conclusion")


@query(f"""WITH {PAPERS} SELECT CASE id % 4 WHEN 0 THEN concat('x', CAST(id AS VARCHAR)) ELSE arxiv_id END AS key, title, CASE WHEN id % 3 = 0 THEN concat(lang, '|', source) WHEN id % 3 = 1 THEN source ELSE '' END AS authors, CAST(coalesce(CASE WHEN id % 2 = 0 THEN n_chars END, 0) AS BIGINT) AS citations, CAST(0 AS INT) AS year FROM papers WHERE id % 4 < 3""")
def normalize_results(spark, sf_dir):
    k = F.col("id") % 4
    url = F.when(k == 2, F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id", F.lit("v1"))).otherwise("https://example.com/x")
    people = F.when(F.col("id") % 3 == 0, F.to_json(F.array("lang", "source"))).when(F.col("id") % 3 == 1, F.to_json(F.array(F.struct(F.col("source").alias("name")), F.struct(F.lit("").alias("name")))))
    raw = papers(spark, sf_dir).select(F.when(k == 0, F.concat(F.lit("x"), F.col("id").cast("string"))).alias("external_id"), F.when(k == 1, F.col("arxiv_id")).alias("arxiv_id"), url.alias("url"), "title", people.alias("authors"), F.when(F.col("id") % 2 == 0, F.col("n_chars")).alias("citations"), F.lit(None).cast("int").alias("year"))
    return T.normalize_results(raw).select("key", "title", F.array_join("authors", "|").alias("authors"), "citations", "year")


@query(f"WITH {PAPERS} SELECT id FROM papers WHERE length(trim(coalesce(full_text, ''))) > 0 OR abstract IS NOT NULL OR conclusion IS NOT NULL")
def has_text(spark, sf_dir):
    return O.has_text(papers(spark, sf_dir)).select("id")


@query(f"""WITH {PAPERS}, p AS (SELECT p.*, e.embedding, CASE WHEN p.id % 2 = 0 THEN [1] END AS neighbours FROM papers p LEFT JOIN embeddings e ON e.vec_id = p.id)
SELECT id, 'tldr' AS missing FROM (SELECT id FROM p WHERE tldr IS NULL OR trim(tldr) = '' ORDER BY id LIMIT 50) UNION ALL SELECT id, 'ss_id' FROM (SELECT id FROM p WHERE ss_id IS NULL AND arxiv_id IS NOT NULL ORDER BY id LIMIT 50)
UNION ALL SELECT id, 'embedding' FROM (SELECT id FROM p WHERE embedding IS NULL AND (abstract IS NOT NULL OR conclusion IS NOT NULL) ORDER BY id LIMIT 50) UNION ALL SELECT id, 'neighbours' FROM (SELECT id FROM p WHERE embedding IS NOT NULL AND neighbours IS NULL ORDER BY id LIMIT 50)""")
def pending(spark, sf_dir):
    p = papers(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left").withColumn("neighbours", F.when(F.col("id") % 2 == 0, F.array(F.lit(1))))
    some = [O.pending(p, kind, 50).select("id", F.lit(kind).alias("missing")) for kind in ("tldr", "ss_id", "embedding", "neighbours")]
    return O.union_edges(*some)


@query(f"WITH {PAPERS} SELECT id, title FROM papers WHERE title ILIKE '%tion%' OR abstract ILIKE '%tion%' ORDER BY id DESC LIMIT 40")
def keyword_filter(spark, sf_dir):
    return O.keyword_filter(papers(spark, sf_dir), "tion", 40).select("id", "title")


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
u AS (SELECT *, i - CASE WHEN max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) = 1 THEN 1 ELSE 0 END AS j FROM t)
SELECT conv_id, count(*) AS n, CASE WHEN bool_or(trim(text) = '') THEN 'blank' WHEN sum(CASE WHEN j >= 0 THEN 1 ELSE 0 END) < 2 THEN 'short' WHEN bool_or(j >= 0 AND role <> CASE WHEN j % 2 = 0 THEN 'user' ELSE 'assistant' END) THEN 'order' ELSE 'ok' END AS verdict FROM u GROUP BY conv_id""")
def validate_conversations(spark, sf_dir):
    from ..operators.conversations import validate

    return validate(table(spark, sf_dir, "conversations"))
