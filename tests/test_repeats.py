"""Larger tables: ids of more digits, keys that repeat, ties, blocks that are full."""

import re

from pyspark.sql import functions as F


def test_ids_of_more_digits_stay_whole(spark):
    from corpusgraph.functions.text import extract_paper_id
    from corpusgraph.sources.landing import normalize_payload

    rows = spark.createDataFrame([("https://arxiv.org/abs/2308.108308v2",), ("id 2308.108308v1",), ("2308.1083",), ("none",)], "t string")
    assert [tuple(r) for r in rows.select(extract_paper_id(F.col("t")), extract_paper_id(F.col("t"), True)).collect()] == [("2308.108308", "2308.108308"), ("2308.108308", "2308.108308"), ("2308.1083", "2308.1083"), (None, None)]
    raw = spark.createDataFrame([('{"ids": {"arxiv": "https://arxiv.org/abs/2001.185092"}}',)], "raw string")
    assert normalize_payload(raw, "openindex").first()["entry_id"] == "https://arxiv.org/abs/2001.185092"


def test_papers_that_share_an_entry_are_one_node_each(spark):
    from corpusgraph.operators.tables import paper_nodes

    papers = spark.createDataFrame([(1, "one", "2001.10000"), (90001, "two", "2001.10000")], "id long, title string, arxiv_id string")
    clusters = spark.createDataFrame([(1, 7)], "paper_id long, cluster_id int")
    bronze = spark.createDataFrame([(1, "https://arxiv.org/abs/2001.10000", '{"authors": ["a"]}'), (90001, "https://arxiv.org/abs/2001.10000", '{"authors": ["b"]}')], "id long, entry_id string, payload string")
    nodes = lambda b: sorted((r["id"], r["authors"]) for r in paper_nodes(papers, b, clusters).collect())
    assert nodes(bronze) == [(1, "a"), (90001, "b")]
    assert nodes(bronze.drop("id")) == [(1, "b"), (90001, "b")]


def test_ties_are_settled_in_any_order(spark):
    from corpusgraph.operators.tables import dedupe_edges, link_details

    tied = [(1, 2, "SUPPORT", 0.5, r, 10) for r in ("r9", None, "r1", "r5")]
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    got = set()
    for order in (tied, tied[::-1], tied[2:] + tied[:2]):
        e = spark.createDataFrame([*order, (1, 2, "SIMILAR", 0.5, None, 11)], "source_id long, target_id long, kind string, strength double, reason string, seq long").coalesce(1)
        kept = {r["kind"]: r["reason"] for r in dedupe_edges(e).collect()}
        said = {r["reason"] for r in link_details(e, nodes).where("kind = 'SIMILAR'").collect()}
        got.add((kept["SUPPORT"], *said))
    assert got == {("r9", "r1")}


def test_tied_reasons_are_taken_as_they_stand_in_the_table(spark, sf, tmp_path):
    from compare import compare
    from corpusgraph.plans.catalog import ORACLES, QUERIES

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where("false")
    rows = [(1, 2, s, 1, 1.0, 1.0, 0.1, 0.0, "R", "O", None) for s in (9, 1, 5)] + [(1, 2, 0, 2, 1.0, 1.0, 0.1, 0.0, "A", "F", None)]
    spark.createDataFrame(rows, lines.schema).coalesce(1).write.parquet(str(tmp_path / "few"))
    next((tmp_path / "few").glob("part-*")).rename(tmp_path / "lineitem.parquet")
    (tmp_path / "documents.parquet").symlink_to(f"{sf}/documents.parquet")
    got = QUERIES["link_details"](spark, str(tmp_path)).where("kind = 'SIMILAR'").collect()
    assert [r["reason"] for r in got] == ["r9"]
    compare(spark, "link_details", QUERIES["link_details"], ORACLES["link_details"], str(tmp_path))


def test_a_full_block_of_vectors_takes_bounded_memory():
    """The largest block that knn() makes of vectors of 64 numbers, against fewer queries than it may meet."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from corpusgraph.operators.neighbours import BLOCK_BYTES, _nearest

    n = BLOCK_BYTES // (64 * 8)
    v = np.random.default_rng(5).normal(size=(n, 64)).astype(np.float32)
    block = pd.DataFrame({"id": np.arange(n), "v": list(v)})
    tracemalloc.start()
    got = _nearest(5, -1.0, [])((), block.iloc[:2048], block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20, peak
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    score = unit[:3] @ unit.T
    score[np.arange(3), np.arange(3)] = -1
    assert [sorted(got.loc[got["id"] == i, "neighbour"]) for i in range(3)] == [sorted(np.argsort(-score[i])[:5]) for i in range(3)]


def test_citations_by_rule_are_asked_of_what_is_found(spark, sf):
    from corpusgraph.operators.neighbours import rank_candidates
    from corpusgraph.plans.catalog import QUERIES

    v = spark.range(60).select("id", F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("embedding"), F.lit("c").alias("composition"), F.lit("m").alias("model"))
    anchors = v.where("id % 10 = 0").select("id")
    rule = (F.col("anchor") + F.col("candidate")) % 7 == 0
    pairs = anchors.select(F.col("id").alias("anchor")).crossJoin(v.select(F.col("id").alias("candidate"))).where(rule)
    got, want = (sorted(map(tuple, rank_candidates(v, anchors, c, 20).select("anchor", "candidate", "rank", "is_cited").collect())) for c in (rule, pairs))
    assert got == want and {r[-1] for r in got} == {True, False}
    plan = QUERIES["rank_candidates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 2  # the anchors' vectors of each composition; no table of cited pairs


def test_win_rates_take_one_shuffle_of_the_scores(spark):
    from corpusgraph.operators.metrics import win_rates

    rows = [(1, "a", 2.0), (1, "a", 1.0), (1, "b", 2.0), (2, "b", 0.0), (2, "a", 3.0), (3, "b", 1.0), (3, "b", 1.0), (None, "a", 1.0)]
    rates = win_rates(spark.createDataFrame(rows, "item long, method string, score double"))
    assert rates._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # by item, and the methods' sums
    assert {r["method"]: (r["avg_score"], r["positive"], r["win_rate"]) for r in rates.collect()} == {"a": (1.75, 1.0, 1.25), "b": (1.0, 0.75, 0.5)}


def test_pages_of_placed_documents_are_not_shuffled_again(spark, sf):
    from corpusgraph.plans.catalog import QUERIES

    plan = QUERIES["assemble_pages"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate") < plan.index("Exchange ")  # below it: documents, not pages


def test_texts_without_anything_to_replace_are_only_searched(spark):
    from corpusgraph.functions.text import normalize_text

    rows = ["a b\nc", " a\t\tb  c\n\n\n\nd\0e \n", "\0\0x\t", "\x0bx y\x0c", "a\n \n\n\n b", "", "\n", None, "\u00a0x\u00a0", "x\n\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", normalize_text(F.col("t")).alias("n"))
    plain = lambda t: None if t is None else re.sub("\n{3,}", "\n\n", re.sub(r"[ \t]{2,}|\t", " ", t.replace("\0", " "))).strip(" \t\n\x0b\f\r")
    assert [r["n"] for r in df.orderBy("i").collect()] == [plain(t) for t in rows]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert all(plan.count(f) == plan.count(f"THEN {f}") == 1 for f in ("translate(", "btrim(")) and plan.count("THEN regexp_replace(") == plan.count("regexp_replace(") == 2


def test_options_are_turned_once_for_their_common_end(spark):
    from corpusgraph.operators.packing import answer_spans

    rows = spark.createDataFrame([([["a", "x", "y"], ["b", "c", "x", "y"]],)], "o array<array<string>>").select(answer_spans(F.col("o"), "schema").alias("s"))
    assert rows._jdf.queryExecution().analyzed().toString().count("reverse(") == 1
    assert [(s["start"], s["end"]) for s in rows.first()["s"]] == [(1, 3), (2, 4)]


def test_upserts_keep_papers_that_share_an_arxiv_id(spark):
    from corpusgraph.operators.tables import upsert_papers

    columns = "id long, arxiv_id string, ss_id string, full_text string, conclusion string, tldr string, full_text_source string"
    table = lambda *rows: spark.createDataFrame([(*r, None, None, "x") for r in rows], columns)
    merge = lambda t, s: sorted((r["id"] or 0, r["arxiv_id"], r["ss_id"], r["full_text"]) for r in upsert_papers(table(*t), table(*s)).collect())
    none = (99, "z", None, "z")
    assert merge([none], [(1, "a", None, "one"), (90001, "a", None, "two")]) == [(1, "a", None, "one"), (*none,), (90001, "a", None, "two")]
    assert merge([(1, "a", "s1", "t1"), (2, "a", "s2", "t2")], [(None, "a", "s1", "one"), (None, "a", "s2", "twice")]) == [(1, "a", "s1", "one"), (2, "a", "s2", "twice")]
    assert merge([(1, "a", None, "t")], [(1, "a", None, "one"), (2, "a", None, "two"), (None, "b", "s3", "3"), (None, "b", "s4", "4")]) == [(0, "b", "s3", "3"), (0, "b", "s4", "4"), (1, "a", None, "one"), (2, "a", None, "two")]
    assert merge([(1, "a", None, "t"), (2, None, "s2", "u")], [(None, "a", "s9", "new"), (7, "c", "s2", "by ss")]) == [(1, "a", "s9", "new"), (2, "c", "s2", "by ss")]


def test_upserts_move_texts_once(spark):
    """Source rows are dealt out once by what names them and read by both that need them; ids alone go through the steps."""
    from corpusgraph.operators.tables import upsert_papers

    columns = "id long, arxiv_id string, ss_id string, full_text string, conclusion string, tldr string, full_text_source string"
    table = lambda *rows: spark.createDataFrame([(*r, None, None, "x") for r in rows], columns)
    found = upsert_papers(table((1, "a", "s1", "t")), table((2, None, "s1", "u"), (2, None, "s1", "u"), (None, None, None, "v"), (None, None, None, "v")))

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    moved = [n for n in nodes(found._jdf.queryExecution().executedPlan().initialPlan()) if n.nodeName() == "Exchange" and "full_text" in n.output().toString()]
    assert len(moved) <= 2, len(moved)
    assert sorted((r["id"] or 0, r["full_text"]) for r in found.collect()) == [(0, "v"), (0, "v"), (1, "u")]


def test_upserts_of_repeated_arxiv_ids_give_the_rows_of_the_sql(spark, sf, tmp_path):
    from compare import compare, database
    from corpusgraph.operators.tables import upsert_papers
    from corpusgraph.plans.catalog import ORACLES, QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    again = lambda n: docs.withColumn("doc_id", F.col("doc_id") + 90_000 * n)
    docs.unionByName(again(1)).unionByName(again(2)).coalesce(1).write.parquet(str(tmp_path / "few"))
    next((tmp_path / "few").glob("part-*")).rename(tmp_path / "documents.parquet")
    assert len(database(str(tmp_path)).execute(ORACLES["upsert_papers"]).fetchall()) > 180
    compare(spark, "upsert_papers", QUERIES["upsert_papers"], ORACLES["upsert_papers"], str(tmp_path))

    columns = "id long, arxiv_id string, ss_id string, full_text string, conclusion string, tldr string, full_text_source string"
    table = lambda *rows: spark.createDataFrame([(*r, None, None, "x") for r in rows], columns)
    target = table((1, "a", "s1", "t"), (2, None, "s2", "u"), (3, None, None, "v"), (4, "d", "s4", "w"))
    source = table((None, None, "s2", "n"), (None, None, None, "alone"), (None, None, None, "alone"), (None, "d", "s1", "e"), (None, "f", "s1", "g"))
    got = sorted((r["id"] or 0, r["full_text"]) for r in upsert_papers(target, source, every=True).collect())
    assert got == [(0, "alone"), (0, "alone"), (1, "g"), (2, "n"), (3, "v"), (4, "e")]


def test_streams_keep_papers_that_share_an_arxiv_id(spark, tmp_path):
    import json

    from corpusgraph.streaming import incremental as I

    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    for name, rows in (("a", [(1, "x"), (2, "x"), (3, "y")]), ("b", [(1, "x"), (2, "x"), (4, "x")])):
        (raw / f"{name}.json").write_text("\n".join(json.dumps({"id": i, "arxiv_id": a, "title": f"{name}{i}", "refs": [{"arxiv_id": "x"}]}) for i, a in rows))
        I.stream_pipeline(spark, str(raw), out, str(tmp_path / "cp"), ("papers", "edges")).awaitTermination()
    assert sorted((r["id"], r["title"]) for r in I.current_papers(spark, out).collect()) == [(1, "b1"), (2, "b2"), (3, "a3"), (4, "b4")]
    edges = I.current(spark, out + "/edges", ["source_id", "target_id", "kind"]).collect()
    assert sorted((r["source_id"], r["target_id"]) for r in edges) == [(1, 2), (1, 4), (2, 1), (2, 4), (3, 1), (3, 2), (4, 1), (4, 2)]


def test_many_buckets_are_met_in_blocks(spark):
    """Wide searches find what a walk through the buckets finds, with few and with many candidates, without a copy for each
    bucket."""
    import numpy as np

    from corpusgraph.operators import neighbours as N

    v = np.random.default_rng(3).normal(size=(400, 8)).astype(np.float32)
    v[200:210] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    score = unit @ unit.T
    for tables, bits, probes in ((8, 3, 1), (2, 3, 4), (1, 2, 4)):
        own, asked = N.lsh_codes(v.astype(np.float64), tables, bits, 1)[..., 0], N.lsh_codes(v.astype(np.float64), tables, bits, probes)
        got = N.knn_approx(df, 7, tables=tables, bits=bits, probes=probes)
        assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
        found = {}
        for r in got.collect():
            found.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
        for i in range(400):
            near = (asked[i][None] == own[:, :, None]).any((1, 2)) & (np.arange(400) != i)
            want = sorted(np.nonzero(near)[0], key=lambda j: (-round(score[i, j], 9), j))[:7]
            assert [n for _, n in sorted(found.get(i, []))] == want, (i, tables)


def test_conclusions_are_looked_for_once(spark):
    from corpusgraph.functions.text import extract_conclusion, extract_conclusion_simple

    para = "We have  shown\tthat the method works on\n all of the sets that were tried in this study."
    text = f"Intro\n\n2 Conclusion\n{para}\n \n{para} $x$ and\r\nmore\n\n3. Appendix\nleft out"
    rows = spark.createDataFrame([(text,)], "t string").select(extract_conclusion(F.col("t")).alias("a"), extract_conclusion_simple(F.col("t")).alias("b"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("Bibliography") == 2  # once for each variant
    assert plan.count("Concluding") == 3  # asked for and taken, and its place
    flat = "We have shown that the method works on all of the sets that were tried in this study."
    assert tuple(rows.first()) == (f"{flat}\n\n{flat} and more", f"Conclusion {flat} {flat} and more")


def test_encoders_get_a_few_texts_of_a_batch_at_once(spark):
    from corpusgraph.operators.neighbours import hash_embed

    def load():
        def wary(texts):  # what it is given fills its memory
            assert 0 < len(texts) <= 256 and texts == sorted(texts, key=len)
            return [[float(len(t))] for t in texts]

        return wary

    df = spark.range(0, 1500, 1, 1).select("id", F.when(F.col("id") % 5 != 0, F.expr("repeat('x', int(id % 37))")).alias("text"))
    got = {r["id"]: r["embedding"] for r in hash_embed(df, "text", load=load).collect()}
    assert got == {i: [float(i % 37)] if i % 5 else None for i in range(1500)}
