"""Every registered query against its SQL, and those without SQL for rows and invariants."""

import pytest
from compare import compare
from pyspark.sql import functions as F

from corpusgraph.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    compare(spark, name, QUERIES[name], ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_pretokens_lose_nothing(spark, sf):
    assert QUERIES["pretokens"](spark, sf).where("not whole").count() == 0


def test_packed_rows_are_full(spark, sf):
    assert QUERIES["pack_crop"](spark, sf).where("n <> 513").count() == 0
    assert QUERIES["pack_crop"](spark, sf).where("first <> 0").count() == 0
    assert QUERIES["pack_pad"](spark, sf).where("(row >= 0 and n <> 513) or (row < 0 and n <= 513)").count() == 0


def test_packing_and_upserts_take_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = sorted(r["n"] for r in docs.select(F.size(F.split("text", " ")).alias("n")).where("n > 513").collect())
    assert long[-1] > 700
    assert sorted(r["n"] for r in QUERIES["pack_pad"](spark, sf).where("row < 0").collect()) == long
    whole = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = QUERIES["upsert_papers_whole"](spark, sf).where("id is not null").select("id", "full_text", "full_text_source").collect()
    assert {r["full_text_source"] for r in got} == {"old", "new"}
    want = {i: " " if i % 12 == 8 else ("new " if i % 2 == 0 and i % 4 else "") + t for i, t in whole.items()}  # blank texts win only where there is none
    assert {r["id"] for r in got} >= {i for i in whole if i % 3 < 2}
    assert [r["id"] for r in got if r["full_text"] != want[r["id"]]] == []


def test_padded_packing_keeps_every_token(spark):
    from corpusgraph.operators.packing import pack

    docs = spark.range(50).select("id", F.expr("transform(sequence(1, int(1 + id * 7 % 23)), x -> int(id * 100 + x))").alias("tokens"))
    got = pack(docs, 16, buffer=5, pad=0)
    flat = got.select(F.explode("tokens").alias("t")).where("t <> 0").groupBy().agg(F.count("*"), F.sum("t")).first()
    assert tuple(flat) == tuple(docs.select(F.explode("tokens").alias("t")).agg(F.count("*"), F.sum("t")).first())
    again = pack(docs.repartition(7), 16, buffer=5, pad=0)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    for r in got.collect():
        assert r["targets"] == [t or -1 for t in r["tokens"][1:]]


def test_packing_takes_the_longest_that_fits(spark):
    from corpusgraph.operators.packing import pack

    sizes = {1: 4, 2: 9, 3: 3, 4: 6, 5: 6, 6: 12, 7: 2, 8: 10}
    docs = spark.createDataFrame([(i, [i] * n, [int(i % 2)] * n, 0) for i, n in sizes.items()], "id long, tokens array<int>, mask array<int>, shard int")
    crop = [r["tokens"] for r in sorted(pack(docs, 10, buffer=3, marker=0).collect(), key=lambda r: r["row"])]
    held, queue, want = [], [(i, [0] + [i] * n) for i, n in sizes.items()], []
    while True:  # the same, plainly
        row = []
        while len(row) < 10:
            while len(held) < 3 and queue:
                held.append(queue.pop(0))
            if not held:
                break
            fits = [x for x in held if len(x[1]) <= 10 - len(row)]
            best = max(fits, key=lambda x: (len(x[1]), -x[0])) if fits else min(held, key=lambda x: (len(x[1]), -x[0]))
            held.remove(best)
            row += best[1][: 10 - len(row)]
        if len(row) < 10:
            break
        want.append(row)
    assert crop == want
    pad = pack(docs, 10, buffer=3, pad=0, mask="mask").collect()
    assert sorted(t for r in pad for t in r["tokens"] if t) == sorted(i for i, n in sizes.items() for _ in range(n))
    assert [r["tokens"] for r in pad if r["row"] < 0] == [[6] * 12] and all(t == -1 or t % 2 for r in pad for t in r["targets"])


def test_chunk_ids_are_unique_and_stable(spark, sf):
    a, b = (QUERIES["chunk_ids"](spark, sf) for _ in range(2))
    assert a.count() == a.select("chunk_id").distinct().count()
    assert a.exceptAll(b).count() == 0


def test_quadratic_fit(spark):
    from corpusgraph.operators.metrics import quadratic_fit

    df = spark.range(1, 60).selectExpr("'g' as g", "double(id) as x", "2 * pow(log10(id), 2) - 3 * log10(id) + 5 as y")
    r = quadratic_fit(df, "x", "y", "g").first()
    assert [round(v, 6) for v in (r["a"], r["b"], r["c"])] == [2, -3, 5]
    assert abs(r["vertex"] - 10**0.75) < 1e-6


def test_optimum_interpolates(spark):
    from corpusgraph.operators.metrics import optimum

    rows = [("g", 10.0**k, (k - 2.5) ** 2 + 1, 100.0 * k, k / 2.0) for k in (1, 2, 3, 4)] + [("flat", 10.0, 3.0, 7.0, 1.0), ("flat", 100.0, 2.0, 8.0, 2.0)]
    got = {r["g"]: r for r in optimum(spark.createDataFrame(rows, "g string, effective_params double, val_bpb double, tokens_trained double, ratio double"), "g").collect()}
    g = got["g"]
    assert abs(g["params"] - 10**2.5) < 1e-3 and abs(g["bpb"] - 1) < 1e-6 and abs(g["tokens_trained"] - 250) < 1e-6 and abs(g["ratio"] - 1.25) < 1e-6
    assert (got["flat"]["params"], got["flat"]["bpb"], got["flat"]["tokens_trained"]) == (100.0, 2.0, 8.0)


def test_extract_conclusion(spark):
    from corpusgraph.functions.text import extract_conclusion

    para = "We have shown that the method works on all of the sets that were tried in this study."
    text = f"Intro\n\n5. Conclusion\n{para}\n\nShort.\n\n[1] doi:10.1/x a reference paragraph that is long enough to be kept otherwise\n\nReferences\nmore"
    second = f"A\nSummary and Discussion\nno\nConcluding Remarks\n{para}"
    rows = spark.createDataFrame([(text,), (second,), ("nothing",), (None,)], "t string").select(extract_conclusion(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in rows] == [para, para, "", ""]


def test_sections(spark):
    from corpusgraph.operators.chunking import build_sections, sections

    rows = spark.createDataFrame([("front\nIntroduction\nhello there\n2.1 METHODS\n\nResults\nfine\nExperimental setup\nx",), ("plain text\n3. Methods: of it",), ("",), (None,)], "t string").select(sections(F.col("t")).alias("s")).collect()
    assert [[(s["name"], s["content"]) for s in r["s"]] for r in rows] == [[("introduction", "hello there"), ("results", "fine"), ("methods", "x")], [("body", "plain text\n3. Methods: of it")], [], []]
    papers = spark.createDataFrame([(1, "Introduction\na\nAbstract\nsame\nIntroduction\na", "same", "end")], "id long, full_text string, abstract string, conclusion string")
    assert [(r["name"], r["content"]) for r in build_sections(papers).orderBy("section_order").collect()] == [("introduction", "a"), ("abstract", "same"), ("conclusion", "end")]


def test_pages_over_the_limit(spark):
    from corpusgraph.functions.text import assemble_pages

    pages = [(1, 0, "a" * 200_000), (1, 1, " "), (1, 2, "word " * 40_000), (1, 3, "never"), (2, 0, "x " * 175_100), (2, 1, "y " * 120), (3, 0, None), (4, 5, "b"), (4, 1, "a")]
    got = {r["id"]: r for r in assemble_pages(spark.createDataFrame(pages, "id long, page int, text string")).collect()}
    assert (got[1]["pages_processed"], got[1]["truncated"], len(got[1]["full_text"])) == (2, True, 200_002 + 149_994)
    assert got[2]["pages_processed"] == 0 and got[2]["truncated"] and got[2]["full_text"].startswith("x x")
    assert (got[3]["source"], got[3]["full_text"], got[3]["pages_processed"]) == ("empty_pdf", "", 1)
    assert got[4]["full_text"] == "a\n\nb"


def test_responders_are_asked_again(spark):
    from corpusgraph.operators.tasks import respond

    def moody(prompts):
        if len(prompts) > 1:
            raise RuntimeError("too many")
        return ["" if p == "bad" else p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "p string").coalesce(1)
    got = [tuple(r["response"]) for r in respond(df.where("p is not null"), "p", moody).collect()]
    assert got == [("A", 2, None), (None, 2, "empty response")]
    assert [r["response"]["error"] for r in respond(df.where("p is null"), "p").collect()] == ["empty response"]


def test_unknown_ids_and_kinds(spark, sf):
    import pytest as pt

    from corpusgraph.operators import graph, tables
    from corpusgraph.plans import graph_queries

    with pt.raises(ValueError, match="unknown id"):
        graph.graph_expand(*graph_queries._graph_tables(spark, sf), -5)
    with pt.raises(ValueError, match="unknown kind"):
        tables.pending(spark.range(1), "other")


def test_repeated_source_keys(spark):
    from corpusgraph.operators.tables import upsert_papers

    columns = "id long, arxiv_id string, ss_id string, full_text string, conclusion string, tldr string, full_text_source string"
    target = spark.createDataFrame([(1, "a", None, "old", None, None, "t")], columns)
    source = spark.createDataFrame([(None, "a", None, "newer", None, None, "s"), (None, "a", None, "new", "c", None, "s"), (2, "b", None, None, None, None, "s"), (2, "b", None, None, None, None, "s")], columns)
    assert sorted((r["id"], r["full_text"]) for r in upsert_papers(target, source).collect()) == [(1, "newer"), (2, None)]


def test_equal_neighbours_go_by_id(spark):
    from corpusgraph.operators.neighbours import knn

    v = spark.range(40).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    got = knn(v, 3, blocks=3).where("id = 20").orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == [0, 1, 2]


def test_knn_blocks_agree(spark, sf):
    from corpusgraph.operators.neighbours import knn

    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    one, many = (knn(v, 5, blocks=b).select("id", "neighbour", "rank") for b in (1, 4))
    assert one.exceptAll(many).count() == 0


def test_mixture_is_seeded(spark):
    from corpusgraph.operators.tables import mixture

    t = spark.range(20).select(F.col("id").alias("idx"))
    a, b, c = ([r["idx"] for r in mixture([t, t], seed).orderBy("place").collect()] for seed in (1, 1, 2))
    assert a == b != c


def test_moving_average_in_blocks(spark):
    from corpusgraph.operators.ranking import ema

    rows = [(r, 3 * k + r, float((k * 7 + r) % 11)) for r in (1, 2) for k in range(40)]
    got = {(r["run"], r["step"]): r["ema"] for r in ema(spark.createDataFrame(rows, "run int, step int, v double"), "run", "step", "v", 0.8, width=10).collect()}
    for run in (1, 2):
        s = 0.0
        for n, (_, step, v) in enumerate([r for r in rows if r[0] == run], 1):
            s = 0.8 * s + 0.2 * v
            assert abs(got[run, step] - s / (1 - 0.8**n)) < 1e-9
