"""Tables of the document graph, derived from the driver's tables by Spark, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

_PAPERS = """
SELECT doc_id AS id,
  substring(split_part(text, '\n', 1), 1, 80) AS title,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE substring(text, 1, 300) END AS abstract,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '' ELSE right(text, 200) END AS conclusion,
  CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' ELSE substring(text, 20, 100) END AS tldr,
  text AS full_text,
  concat(CAST(2000 + doc_id % 400 AS {s}), '.', CAST(10000 + doc_id % 90000 AS {s})) AS arxiv_id,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('ss', CAST(doc_id AS {s})) END AS ss_id,
  concat('10.', CAST(doc_id % 500 AS {s}), '/', lang, CAST(doc_id AS {s})) AS doi,
  lang, source, n_chars
FROM {documents}"""

#: SQL of the same tables, to stand after WITH.
PAPERS = "papers AS (" + _PAPERS.format(s="VARCHAR", documents="documents") + ")"

#: Three references of each paper, found by different keys; the third mostly leads nowhere.
REFS = """refs AS (
SELECT id AS paper_id, 0 AS pos, concat('ss', CAST((id * 7 + 1) % 1000 AS VARCHAR)) AS ss_paper_id, CAST(NULL AS VARCHAR) AS arxiv_id, CAST(NULL AS VARCHAR) AS doi FROM papers
UNION ALL SELECT id, 1, NULL, concat(CAST(2000 + ((id * 13 + 5) % 1000) % 400 AS VARCHAR), '.', CAST(10000 + ((id * 13 + 5) % 1000) % 90000 AS VARCHAR)), NULL FROM papers
UNION ALL SELECT id, 2, NULL, NULL, upper(concat('10.', CAST((id * 17) % 1000 % 500 AS VARCHAR), '/en', CAST((id * 17) % 1000 AS VARCHAR))) FROM papers)"""

#: Typed edges with repeats, self loops and missing values.
EDGES = """edges AS (
SELECT l_orderkey % 1000 AS source_id, l_partkey % 1000 AS target_id,
  CASE l_returnflag WHEN 'A' THEN 'SIMILAR' WHEN 'N' THEN CASE WHEN l_linenumber % 5 = 0 THEN 'SUPPORT' ELSE 'CITES' END ELSE CASE WHEN l_linenumber % 3 = 0 THEN 'CONTRADICT' WHEN l_linenumber % 3 = 1 THEN 'NEUTRAL' ELSE NULL END END AS kind,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 10 END AS strength,
  CASE WHEN l_linestatus = 'O' THEN concat('r', CAST(l_suppkey AS {s})) END AS reason,
  l_orderkey * 10 + l_linenumber AS seq{more}
FROM {lineitem})"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spark.sql(_PAPERS.format(s="STRING", documents="{docs}"), docs=docs)


def references(p: DataFrame) -> DataFrame:
    """(paper_id, pos, ss_paper_id, arxiv_id, doi): what papers cite, one row an entry."""
    null, other = F.lit(None).cast("string"), lambda a, b: (F.col("id") * a + b) % 1000
    number = other(13, 5)
    entries = F.array(
        F.struct(F.concat(F.lit("ss"), other(7, 1).cast("string")).alias("ss_paper_id"), null.alias("arxiv_id"), null.alias("doi")),
        F.struct(null.alias("ss_paper_id"), F.concat((2000 + number % 400).cast("string"), F.lit("."), (10000 + number % 90000).cast("string")).alias("arxiv_id"), null.alias("doi")),
        F.struct(null.alias("ss_paper_id"), null.alias("arxiv_id"), F.upper(F.concat(F.lit("10."), (other(17, 0) % 500).cast("string"), F.lit("/en"), other(17, 0).cast("string"))).alias("doi")),
    )
    return p.select(F.col("id").alias("paper_id"), F.posexplode(entries).alias("pos", "e")).select("paper_id", "pos", "e.*")


def edges(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """The edges; placed: with `place`, where the row stands in the table."""
    lines, more = table(spark, sf_dir, "lineitem"), ""
    if placed:
        lines, more = lines.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place")), ", place"
    sql = "WITH " + EDGES.format(s="STRING", lineitem="{lineitem}", more=more) + " SELECT * FROM edges"
    return spark.sql(sql, lineitem=lines)


EDGES_SQL = EDGES.format(s="VARCHAR", lineitem="lineitem", more="")
