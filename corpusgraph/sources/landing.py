"""Landing of raw JSON records: normalization of source dialects and idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_paper_id

#: Schemas of the source dialects.
DIALECTS = {
    "preprint": "id string, title string, summary string, published string, authors array<struct<name:string>>",
    "scholar": "paperId string, title string, abstract string, publicationDate string, year int, citationCount int, authors array<struct<name:string>>, externalIds struct<ArXiv:string,DOI:string>",
    "openindex": "id string, display_name string, publication_date string, cited_by_count int, authorships array<struct<author:struct<display_name:string>>>, ids struct<arxiv:string>",
}


def normalize_payload(df: DataFrame, dialect: str, column: str = "raw", keep: list[str] | None = None) -> DataFrame:
    """(kept columns, entry_id, title, summary, published, authors, citations, ss_id) of records in one dialect; fields that a dialect
    lacks are null, and a record that doesn't parse has nulls alone."""
    r = df.withColumn("r", F.from_json(column, DIALECTS[dialect]))
    names = lambda path, f: F.filter(F.transform(path, f), lambda x: x.isNotNull())
    null = lambda t: F.lit(None).cast(t)
    abs_url = lambda c: F.concat(F.lit("https://arxiv.org/abs/"), c)
    if dialect == "preprint":
        fields = (F.col("r.id"), F.col("r.title"), F.col("r.summary"), F.col("r.published"), names("r.authors", lambda a: a["name"]), null("int"), null("string"))
    elif dialect == "scholar":
        fields = (abs_url(F.col("r.externalIds.ArXiv")), F.col("r.title"), F.col("r.abstract"), F.coalesce("r.publicationDate", F.col("r.year").cast("string")), names("r.authors", lambda a: a["name"]), F.col("r.citationCount"), F.col("r.paperId"))
    else:
        fields = (abs_url(extract_paper_id(F.col("r.ids.arxiv"))), F.col("r.display_name"), null("string"), F.col("r.publication_date"), names("r.authorships", lambda a: a["author"]["display_name"]), F.col("r.cited_by_count"), null("string"))
    return r.select(*(keep or ()), *[f.alias(n) for f, n in zip(fields, ("entry_id", "title", "summary", "published", "authors", "citations", "ss_id"))])


def land(new: DataFrame, bronze: DataFrame, key: str = "entry_id") -> DataFrame:
    """The rows of new to append: those whose key bronze lacks, one for each key."""
    return new.dropDuplicates([key]).join(bronze.select(key), key, "left_anti")


def stamped(rows: DataFrame, key: str = "entry_id") -> DataFrame:
    """rows with ingestion_id, a hash of the key that a replay gives again, and ingested_at, the time of the load."""
    return rows.withColumn("ingestion_id", F.xxhash64(key)).withColumn("ingested_at", F.current_timestamp())


def land_status(new: DataFrame, bronze: DataFrame, seq: str = "seq") -> DataFrame:
    """new with `status`: skipped_no_id without an id in entry_id, skipped_dupe if bronze or an earlier row of new has
    its entry_id or its ss_paper_id, else inserted. Two equi joins, not one with OR."""
    rows = new.withColumn("paper_id", extract_paper_id(F.col("entry_id")))
    known = rows.join(bronze.select("entry_id").distinct().withColumn("by_entry", F.lit(True)), "entry_id", "left")
    known = known.join(bronze.where("ss_paper_id is not null").select("ss_paper_id").distinct().withColumn("by_ss", F.lit(True)), "ss_paper_id", "left")
    fresh = F.col("paper_id").isNotNull() & F.col("by_entry").isNull() & F.col("by_ss").isNull()
    open_ = known.where(fresh)
    first_entry = open_.groupBy("entry_id").agg(F.min(seq).alias("first_entry"))
    first_ss = open_.where("ss_paper_id is not null").groupBy("ss_paper_id").agg(F.min(seq).alias("first_ss"))
    all_ = known.join(first_entry, "entry_id", "left").join(first_ss, "ss_paper_id", "left")
    first = (F.col("first_entry") == F.col(seq)) & (F.col("first_ss").isNull() | (F.col("first_ss") == F.col(seq)))
    status = F.when(F.col("paper_id").isNull(), "skipped_no_id").when(fresh & first, "inserted").otherwise("skipped_dupe")
    return all_.withColumn("status", status).select(*new.columns, "status")


def peek(bronze: DataFrame, limit: int, column: str = "payload") -> DataFrame:
    """(title, entry_id, summary) of the first records, with words for what is missing."""
    v = F.try_parse_json(column)
    field = lambda name, other: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(other)).alias(name)
    return bronze.orderBy("ingestion_id").limit(limit).select("ingestion_id", field("title", "No title"), field("entry_id", "No id"), field("summary", "No abstract"))


def payload(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
