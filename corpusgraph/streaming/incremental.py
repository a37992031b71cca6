"""Structured Streaming over files of raw records, with idempotent writes in each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_corpus
from ..operators.graph import build_edges
from ..operators.tables import upsert_papers
from ..sources.landing import land, stamped

RAW = "entry_id string, title string, abstract string, full_text string, conclusion string, id long, at timestamp"


def stream_land(spark: SparkSession, source: str, bronze: str, checkpoint: str, key: str = "entry_id") -> StreamingQuery:
    """Lands JSON files, each key once, with ingestion_id (a hash of the key) and ingested_at. Keys that have landed are
    state of the stream, in RocksDB beside the executors and in the checkpoint, so no batch reads what is landed and no
    record is too old, also after a restart; bronze is read in a stream's first batch alone, to know what stood there before.
    Each batch writes its own folder, so a replayed batch overwrites itself. Records without a key count as one."""
    raw = spark.readStream.schema(RAW).json(source).dropDuplicates([key])

    def write(batch: DataFrame, n: int) -> None:
        if n == 0 and _exists(batch.sparkSession, bronze):
            others = batch.sparkSession.read.schema(RAW + ", batch int").parquet(bronze).where(F.col("batch") != n)
            batch = land(batch, others, key)
        stamped(batch, key).write.mode("overwrite").parquet(f"{bronze}/batch={n}")

    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rocks)
    try:
        return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stream_chunks(spark: SparkSession, source: str, out: str, checkpoint: str, size: int = 500, overlap: int = 40) -> StreamingQuery:
    """Cuts arriving papers into sections and chunks, batch by batch; ids are hashes, so a replay gives the same rows."""
    raw = spark.readStream.schema(RAW).json(source)

    def write(batch: DataFrame, n: int) -> None:
        chunk_corpus(batch, size, overlap).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Records of the whole pipeline: papers with what they cite and their nearest neighbours.
PAPERS = "id long, arxiv_id string, ss_id string, doi string, title string, abstract string, full_text string, conclusion string, tldr string, full_text_source string, refs array<struct<ss_paper_id:string,arxiv_id:string,doi:string>>, neighbours array<long>"
_COLUMNS = [c.split(" ")[0] for c in PAPERS.split(", ")][:10]


def current(spark: SparkSession, path: str, keys: list[str], before: int | None = None) -> DataFrame:
    """The newest row of each key among all batches at path (those before one batch, to replay it)."""
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("r")).select(*keys, "r.*")


#: A paper's row in the history, under the key that names it, and the ids by which a paper is found.
_STATE = "pid string, deleted boolean, " + ", ".join(f"{c.split(' ')[0]} {c.split(' ')[1]}" for c in PAPERS.split(", ")[:10])
_INDEX = "kind string, value string, pid string, id long"


def paper_key() -> Column:
    """What names a paper: its id, else its arxiv_id, else its ss_id. Papers may share an arxiv_id, but no id."""
    return F.coalesce(F.concat(F.lit("i"), F.col("id").cast("string")), F.concat(F.lit("a"), "arxiv_id"), F.concat(F.lit("s"), "ss_id"))


class History:
    """The newest row of each key (and of each of `per` for it), as a snapshot and the batches since, all in buckets by key: a reader of some keys reads
    their buckets alone, and batches are merged into a new snapshot when there are `every` of them, so reads don't grow
    with the number of batches. A batch's folder is overwritten when it is replayed, and what it reads ends before it."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], per: tuple[str, ...] = (), buckets: int = 64, every: int = 8):
        self.spark, self.path, self.schema, self.keys, self.per, self.buckets, self.every = spark, path, schema, keys, per, buckets, every

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _batches(self, kind: str) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        done = lambda x: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{x}/_SUCCESS"))
        return sorted(int(x.split("=")[1]) for x in names if x.startswith("batch=") and done(x))

    def parts(self, before: int | None = None) -> tuple[list[int], list[int]]:
        """(the newest snapshot, batches since) that a reader before some batch needs."""
        old = lambda kind: [n for n in self._batches(kind) if before is None or n < before]
        snapshot = old("snapshot")[-1:]
        return snapshot, [n for n in old("delta") if not snapshot or n > snapshot[0]]

    def read(self, before: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """The newest rows, of all keys or of those in wanted(keys), whose buckets, some numbers, the driver asks for."""
        snapshot, deltas = self.parts(before)
        read = lambda kind, ns: self.spark.read.schema(f"{self.schema}, batch int, bucket int").option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/batch={n}" for n in ns])
        tables = [read(kind, ns) for kind, ns in (("snapshot", snapshot), ("delta", deltas)) if ns]
        if not tables:
            return self.spark.createDataFrame([], self.schema)
        rows = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
        if wanted is not None:
            wanted = wanted.select(self.keys).distinct()
            rows = rows.where(F.col("bucket").isin([r[0] for r in wanted.select(self.bucket()).distinct().collect()])).join(wanted, self.keys, "left_semi")
        names = [f.name for f in rows.schema if f.name not in ("batch", "bucket")]
        return rows.groupBy(*self.keys, *self.per).agg(F.max_by(F.struct(*names), "batch").alias("r")).select("r.*")

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their bucket, those of one together."""
        return rows.withColumn("bucket", self.bucket()).repartition("bucket")

    def _write(self, rows: DataFrame, kind: str, n: int) -> None:
        rows = rows if "bucket" in rows.columns else self.placed(rows)
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{kind}/batch={n}")

    def add(self, rows: DataFrame, n: int) -> None:
        """Rows of batch n, one for each key and what is kept for it; placed() or not."""
        self._write(rows, "delta", n)
        if len(self.parts()[1]) >= self.every:
            self._write(self.read(), "snapshot", n)


def paper_history(spark: SparkSession, out: str) -> History:
    return History(spark, f"{out}/papers", _STATE, ["pid"])


def current_papers(spark: SparkSession, out: str) -> DataFrame:
    """The papers of a stream as they are now."""
    return paper_history(spark, out).read().where("not deleted").select(_COLUMNS)


def stream_pipeline(spark: SparkSession, source: str, out: str, checkpoint: str, stages: tuple[str, ...] = ("papers", "chunks", "edges")) -> StreamingQuery:
    """Papers, their chunks and their edges, batch by batch, under out; stages left out are skipped. A batch writes the
    papers it changes, merged with what was known of them by id, else by arxiv_id, else by ss_id, and their chunks and edges,
    each in a folder of its own, so a replayed batch overwrites itself. A paper that was known without an id is superseded
    when its id comes. What is known is a History of papers and one of the ids that find them, of which a batch reads the
    buckets of its own ids; current_papers() and current() read the newest rows."""
    raw = spark.readStream.schema(PAPERS).json(source)

    def ids_of(papers: DataFrame) -> DataFrame:
        pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
        each = F.array(pair("arxiv", F.col("arxiv_id")), pair("ss", F.col("ss_id")), pair("doi", F.lower("doi")))
        return papers.select(*[c for c in ("pid", "id") if c in papers.columns], F.inline(each)).where("value is not null")

    def write(batch: DataFrame, n: int) -> None:
        session, save = batch.sparkSession, lambda df, what: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{what}/batch={n}")
        papers, index = paper_history(session, out), History(session, f"{out}/ids", _INDEX, ["kind", "value"], ("pid",))
        new = batch.select(_COLUMNS)
        if "papers" in stages:
            found = index.read(n, ids_of(new.select("arxiv_id", "ss_id", F.lit(None).cast("string").alias("doi"))))
            old = papers.read(n, found.select("pid").unionByName(new.select(paper_key().alias("pid")))).where("not deleted")
            merged = upsert_papers(old.select(_COLUMNS), new).withColumn("pid", paper_key()).withColumn("deleted", F.lit(False))
            rows = papers.placed(merged).dropDuplicates(["bucket", "pid"])  # where they are written, so texts move once
            left = old.select("pid").join(merged.select("pid"), "pid", "left_anti").withColumn("deleted", F.lit(True))  # no more of them is read
            papers.add(rows.unionByName(papers.placed(left), allowMissingColumns=True), n)
            new = session.read.schema(f"{_STATE}, bucket int").parquet(f"{out}/papers/delta/batch={n}").where("not deleted").select("pid", *_COLUMNS)
            index.add(ids_of(new).select("kind", "value", "pid", "id"), n)
        if "chunks" in stages:
            save(chunk_corpus(new), "chunks")
        if "edges" in stages:
            cited = batch.where("refs is not null").select(F.col("id").alias("paper_id"), F.inline("refs"))
            every = new
            if "papers" in stages:
                asked = ids_of(cited.select("arxiv_id", F.col("ss_paper_id").alias("ss_id"), "doi"))
                one = lambda kind, c: F.when(F.col("kind") == kind, F.col("value")).alias(c)
                every = index.read(n + 1, asked).where("id is not null").select("id", one("arxiv", "arxiv_id"), one("ss", "ss_id"), one("doi", "doi"))
            save(build_edges(every, cited, batch.where("neighbours is not null").select("id", "neighbours")), "edges")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_history(turns: DataFrame, n: int) -> DataFrame:
    """turns(session, at, role, text) as a stream -> (session, history) after each batch, with the last n messages of a
    session as state."""

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for b in batches:
            held += [(str(a), f"{r.upper()}: {t}") for a, r, t in zip(b["at"], b["role"], b["text"])]
        held = sorted(held)[-n:]
        state.update((tuple(a for a, _ in held), tuple(line for _, line in held)))
        yield pd.DataFrame({"session": [key[0]], "history": ["\n".join(line for _, line in held)]})

    return turns.groupBy("session").applyInPandasWithState(update, "session long, history string", "at array<string>, line array<string>", "update", "NoTimeout")
