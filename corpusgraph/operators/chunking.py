"""Sections and overlapping word chunks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import let, normalize_text, strip, truncate_words, word_count, words

HEADER = rf"(?imd)^(?:\d+(?:\.\d+)*)?\s*({'|'.join(fixed.SECTION_NAMES)})\s*$"


def canonical_section(name: Column) -> Column:
    """The name that a section goes by; unknown ones are body."""
    said = F.lower(strip(F.coalesce(name, F.lit(""))))
    out = F.when(F.startswith(said, F.lit("limitation")), "limitations").otherwise("body")
    for to, names in fixed.SECTION_ALIASES.items():
        out = F.when(said.isin(names), to).otherwise(out)
    return F.when(F.startswith(said, F.lit("abstract")), "abstract").otherwise(out)


def sections(text: Column) -> Column:
    """array<struct<name, content>>: what stands under each header line; text before the first is dropped, empty
    sections too; without a header one "body"."""
    return _sections(normalize_text(F.coalesce(text, F.lit(""))))


def _sections(clean: Column) -> Column:
    """sections() of a text that is normalized, so that what stands between two headers is too, but for its ends."""
    none = F.slice(F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("content"))), 1, 0)
    content = lambda c, n: truncate_words(c, n).alias("content")

    def section(part: Column) -> Column:
        return let(F.split(part, "\u0002"), lambda p: F.struct(canonical_section(p[0]).alias("name"), content(strip(p[1]), fixed.MAX_SECTION_WORDS)))

    def found(clean: Column) -> Column:
        cut = F.split(F.regexp_replace(clean, HEADER, "\u0001$1\u0002"), "\u0001")
        body = F.array(F.struct(F.lit("body").alias("name"), content(clean, fixed.MAX_TEXT_WORDS)))
        return let(cut, lambda c: F.when(F.size(c) > 1, F.filter(F.transform(F.slice(c, F.lit(2), F.size(c)), section), lambda s: s["content"] != "")).otherwise(body))

    return let(clean, lambda c: F.when(c == "", none).otherwise(found(c)))


def _once(found: Column) -> Column:
    """The sections whose name and first 200 characters no earlier one has."""
    key = lambda x: F.struct(x["name"].alias("name"), F.substring(x["content"], 1, 200).alias("head"))
    return let(found, lambda f: let(F.transform(f, key), lambda keys: F.filter(f, lambda x, i: F.array_position(keys, key(x)) == i + 1)))


def build_sections(papers: DataFrame) -> DataFrame:
    """papers(id, full_text, abstract, conclusion) -> (id, section_order, name, content): the sections of the text, the
    abstract before and the conclusion after them, each once for its name and first 200 characters; those of the text
    count first. A paper's sections are one array, so nothing is shuffled."""
    whole = truncate_words(normalize_text(F.coalesce("full_text", F.lit(""))), fixed.MAX_TEXT_WORDS)
    part = lambda name: normalize_text(F.coalesce(name, F.lit("")))
    rows = papers.select("id", _sections(whole).alias("s"), part("abstract").alias("a"), part("conclusion").alias("c"))
    rows = rows.select("id", _once(F.col("s")).alias("s"), "a", "c")

    def missing(name: str, c: str) -> Column:
        known = F.exists("s", lambda x: (x["name"] == name) & (F.substring(x["content"], 1, 200) == F.substring(c, 1, 200)))
        made = F.array(F.struct(F.lit(name).alias("name"), truncate_words(F.col(c), fixed.MAX_SECTION_WORDS).alias("content")))
        return F.when((F.col(c) != "") & ~known, made).otherwise(F.slice(made, 1, 0))

    every = F.concat(missing("abstract", "a"), F.col("s"), missing("conclusion", "c"))
    return rows.select("id", F.posexplode(every).alias("section_order", "s")).select("id", "section_order", "s.name", "s.content")


def chunks(text: Column, size: int = 500, overlap: int = 40) -> Column:
    """Overlapping runs of `size` words; a text within the size is one chunk, unchanged. The last full step is followed
    by a short tail chunk of `overlap` words when words are left over beyond it."""
    step = size - overlap

    def cut(w: Column) -> Column:
        n = F.size(w)
        last = F.floor((n - size) / step).cast("int") + 1
        starts = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: k * step)
        starts = F.when(n - step * last > overlap, F.concat(starts, F.array(n - overlap))).otherwise(starts)
        made = F.filter(F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " ")), lambda c: c != "")
        return F.when(n <= size, F.array(text)).otherwise(made)

    return let(words(text), cut)


def chunk_corpus(papers: DataFrame, size: int = 500, overlap: int = 40) -> DataFrame:
    """(paper_id, section_id, chunk_id, section_order, chunk_index, chunk_type, token_estimate, chunk_text) of all
    papers; sections over the limit of words are skipped (oversize() counts them). Ids are hashes of the places, so a
    rerun gives the same."""
    short = F.length("content") < 2 * fixed.MAX_SECTION_WORDS  # so many words need more characters
    s = build_sections(papers).where(short | (word_count(F.col("content")) <= fixed.MAX_SECTION_WORDS))
    rows = s.select("id", "section_order", "name", F.posexplode(chunks(F.col("content"), size, overlap)).alias("chunk_index", "chunk_text"))
    return rows.select(F.col("id").alias("paper_id"), F.xxhash64("id", "section_order").alias("section_id"), F.xxhash64("id", "section_order", "chunk_index").alias("chunk_id"), "section_order", "chunk_index", F.col("name").alias("chunk_type"), word_count(F.col("chunk_text")).alias("token_estimate"), "chunk_text")


def oversize(papers: DataFrame) -> DataFrame:
    """(id, oversize): how many sections of each paper chunk_corpus() skips for their length."""
    return build_sections(papers).groupBy("id").agg(F.count_if(word_count(F.col("content")) > fixed.MAX_SECTION_WORDS).alias("oversize"))
