"""The document graph: deterministic and labelled edges, clusters and their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import blend
from .metrics import graph_meta, mean_vector
from .neighbours import knn, topk_query
from .ranking import recent_ids, similar_edges, with_fallback
from .tables import dedupe_edges, edge_threshold, edges_from, keyword_filter, paper_nodes, resolve_citations

_EDGE = ["source_id", "target_id", "kind", "strength", "reason", "seq"]


def build_edges(papers: DataFrame, references: DataFrame, neighbours: DataFrame) -> DataFrame:
    """CITES edges of strength 1 from references and SIMILAR ones from neighbour lists, without self loops, each once."""
    cites = resolve_citations(references, papers).select(F.col("paper_id").alias("source_id"), "target_id", F.lit("CITES").alias("kind"), F.lit(1.0).alias("strength"))
    both = cites.unionByName(similar_edges(neighbours))
    return dedupe_edges(both.withColumn("reason", F.lit(None).cast("string")).withColumn("seq", F.lit(0).cast("long")).select(_EDGE))


def label_queue(neighbours: DataFrame, edges: DataFrame, papers: DataFrame, first: int = 3) -> DataFrame:
    """(source_id, target_id): the first neighbours of each paper without a labelled edge yet, whose conclusion isn't
    empty."""
    pairs = neighbours.select(F.col("id").alias("source_id"), F.posexplode(F.slice("neighbours", 1, first)).alias("pos", "target_id")).drop("pos")
    labelled = edges.where("kind in ('SUPPORT', 'CONTRADICT', 'NEUTRAL')").select("source_id", "target_id").distinct()
    usable = papers.where(F.trim(F.coalesce("conclusion", F.lit(""))) != "").select(F.col("id").alias("target_id"))
    return pairs.join(labelled, ["source_id", "target_id"], "left_anti").join(usable, "target_id", "left_semi").distinct()


def semantic_edges(responses: DataFrame) -> DataFrame:
    """responses(source_id, target_id, source_text, response, seq) -> labelled edges; without source text NEUTRAL."""
    empty = F.trim(F.coalesce("source_text", F.lit(""))) == ""
    kind = F.when(empty, "NEUTRAL").otherwise(T.parse_label(F.col("response")))
    reason = F.when(empty, "").otherwise(T.parse_reason(F.col("response")))
    return dedupe_edges(responses.select("source_id", "target_id", kind.alias("kind"), F.lit(1.0).alias("strength"), reason.alias("reason"), "seq"))


def kmeans(df: DataFrame, k: int, seed: int = 42, column: str = "embedding", key: str = "id") -> DataFrame:
    """(key, cluster_id) by k-means with at most as many clusters as rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(column).isNotNull()).select(key, array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    n = rows.limit(k).count()
    if n < 2:
        return rows.select(key, F.lit(0).alias("cluster_id"))
    return KMeans(k=n, seed=seed, predictionCol="cluster_id").fit(rows).transform(rows).select(key, "cluster_id")


def stop_words() -> list[str]:
    """Frequent English words that name no topic: Spark's list, cut at apostrophes as texts are."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({part for w in StopWordsRemover.loadDefaultStopWords("english") for part in w.split("'") if len(part) > 2})


def terms_of(text: Column) -> Column:
    """The lower-cased words of three or more letters a-z; a word with other letters, digits or _ in it is none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.rlike(w, F.lit("^[a-z]{3,}$")))


def cluster_keywords(members: DataFrame, k: int = 3, vocabulary: int = 1000, stop: list[str] | None = None) -> DataFrame:
    """members(cluster_id, text) -> (cluster_id, keywords): the k terms of greatest tf * idf of each cluster, idf as
    ln((1 + n) / (1 + df)) + 1, over the most frequent terms but for stop words (stop_words() by default)."""
    terms = members.select("cluster_id", F.explode(terms_of(F.col("text"))).alias("term")).where(~F.col("term").isin(stop_words() if stop is None else stop))
    tf = terms.groupBy("cluster_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(vocabulary)
    n = members.select("cluster_id").distinct().agg(F.count("*").alias("n"))
    scored = tf.join(df, "term").crossJoin(n).withColumn("score", F.round(F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1), 9))  # n is one row
    w = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "term")
    top = scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return top.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "term"))), lambda x: x["term"]), ", ").alias("keywords"))


def cluster_prompts(members: DataFrame, keywords: DataFrame, titles: int = 5) -> DataFrame:
    """(cluster_id, prompt): the first titles of a cluster and its keywords."""
    w = Window.partitionBy("cluster_id").orderBy("id")
    first = members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= titles)
    lines = first.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "title"))), lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("lines"))
    return lines.join(keywords, "cluster_id").select("cluster_id", F.concat(F.lit("Name this group.\n"), "lines", F.lit("\nKeywords: "), "keywords").alias("prompt"))


def cluster_rows(members: DataFrame, names: DataFrame) -> DataFrame:
    """members(cluster_id, id), names(cluster_id, name, description) -> (paper_id, cluster_id, cluster_label, cluster_name,
    cluster_description), a row for each member, to be put in place by upsert_by_key()."""
    return members.select("id", "cluster_id").join(names, "cluster_id", "left").select(F.col("id").alias("paper_id"), "cluster_id", F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string")).alias("cluster_label"), F.col("name").alias("cluster_name"), F.col("description").alias("cluster_description"))


def blend_vectors(vectors: DataFrame, references: DataFrame, papers: DataFrame, alpha: float = 0.7) -> DataFrame:
    """vectors(id, embedding) with case and blended: alpha of a paper's vector and the rest of the mean of those it cites,
    normalized ("blended"); its own where it cites nothing that is known ("no refs") or nothing with a vector ("no
    vectors"). Counts of the cases are a groupBy away."""
    refs = resolve_citations(references, papers)
    found = refs.join(vectors.select(F.col("id").alias("target_id"), "embedding"), "target_id").select(F.col("paper_id").alias("id"), "embedding")
    known = refs.select(F.col("paper_id").alias("id")).distinct().withColumn("known", F.lit(True))
    j = vectors.join(mean_vector(found, "id"), "id", "left").join(known, "id", "left")
    case = F.when(F.col("mean").isNotNull(), "blended").when(F.col("known"), "no vectors").otherwise("no refs")
    return j.select(*vectors.columns, case.alias("case"), blend(F.col("embedding"), F.col("mean"), alpha).alias("blended"))


def _view(ids: DataFrame, papers: DataFrame, bronze: DataFrame, clusters: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = paper_nodes(papers, bronze, clusters, ids)
    links = edge_threshold(edges_from(edges, ids)).select("source_id", "target_id", "kind", "strength", "reason")
    return nodes, links, graph_meta(nodes, links)


def graph_query(papers: DataFrame, bronze: DataFrame, clusters: DataFrame, edges: DataFrame, query: str, vector: list[float] | None, k: int = 20, threshold: float = -1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, meta) of the k papers that answer a query: those nearest to its vector, else (no vector given or none
    found) those whose title or abstract holds it, else the newest. papers(id, title, abstract, arxiv_id, embedding)."""
    one = lambda ids: ids.select(F.lit(0).alias("query"), "id")
    found = [one(keyword_filter(papers, query, k)), one(recent_ids(papers, k))]
    if vector is not None:
        found.insert(0, one(topk_query(papers.where("embedding is not null"), vector, k, threshold)))
    return _view(with_fallback(*found).select("id"), papers, bronze, clusters, edges)


def graph_expand(papers: DataFrame, bronze: DataFrame, clusters: DataFrame, edges: DataFrame, id: int, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, meta) of the k papers nearest to one; ValueError if it is unknown, none if it has no vector."""
    row = papers.where(F.col("id") == id).select("embedding").first()
    if row is None:
        raise ValueError(f"unknown id {id}")
    others = papers.where((F.col("id") != id) & F.col("embedding").isNotNull())
    near = topk_query(others, list(row["embedding"]), k) if row["embedding"] is not None else others.limit(0)
    return _view(near.select("id"), papers, bronze, clusters, edges)


def graph_expand_all(papers: DataFrame, bronze: DataFrame, clusters: DataFrame, edges: DataFrame, ids: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graph_expand() for all ids(id) in one plan: (nodes, links, meta), each with `query`, the id that it is of. No vector
    passes through the driver; ids that are unknown or have no vector have no rows."""
    asked = papers.join(ids.select(F.col("id").alias("__asked")).distinct(), F.col("id") == F.col("__asked"), "left_semi")
    near = knn(papers, k, queries=asked).select(F.col("id").alias("query"), F.col("neighbour").alias("id"))
    nodes = near.join(paper_nodes(papers, bronze, clusters, near.select("id").distinct()), "id").select("query", "id", "label", "short", "title", "authors", "year", "citations", "cluster_id")
    of_source = near.select("query", F.col("id").alias("source_id"))
    links = edge_threshold(edges).join(of_source, "source_id").select("query", "source_id", "target_id", "kind", "strength", "reason")
    counts = links.groupBy("query").agg(F.count("*").alias("total_links"))
    meta = near.groupBy("query").agg(F.count("*").alias("total_nodes")).join(counts, "query", "left").select("query", "total_nodes", F.coalesce("total_links", F.lit(0)).alias("total_links"))
    return nodes, links, meta
