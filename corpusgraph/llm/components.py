"""Connected components of a graph given as pairs, with large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Edges of a partition in the rounds, about.
ROWS = 50_000


def _mark(edges: DataFrame) -> tuple:
    """Two sums that change when the set of edges does."""
    h = F.xxhash64("u", "v")
    got = edges.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return got["n"], got["s"]


def _fewer(rows: DataFrame, edges: int) -> DataFrame:
    """rows in as many partitions as so many edges need: those of a shuffle suit the input, of which edges are a small part."""
    parts = -(-edges // ROWS)
    return rows.coalesce(parts) if 0 < parts < int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # large: every neighbour above u is linked to the least of u and its neighbours; small: every one below u, and u
    near = both if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return _fewer(_fewer(out.where("u <> v"), n).distinct(), n)


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """pairs(u long, v long) -> (node, root): each linked node and the least node it reaches.

    Each round is written to the shared folder; only a count and a checksum reach the driver. Self pairs and repeated
    pairs change nothing; no pairs give no rows.
    """
    edges = stored(pairs.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    if (few := _fewer(edges, mark[0])) is not edges:  # each round reads them several times, so first their files become few
        old, edges = edges, stored(few, "edges")
        forget(old)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        old, edges = edges, stored(_star(_star(edges, True, mark[0]), False, mark[0]), "edges")
        forget(old)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
