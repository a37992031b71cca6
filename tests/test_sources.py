"""Files in and out, and incremental runs."""

import json

from pyspark.sql import functions as F

from corpusgraph.operators.chunking import chunk_corpus
from corpusgraph.operators.tables import require_columns
from corpusgraph.sources import corpus as S
from corpusgraph.streaming import incremental as I


def test_shards_hold_all_documents_once(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    S.write_shards(docs, str(tmp_path / "shards"), shard_chars=50_000, group=8)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and back.select("text").exceptAll(docs.select("text")).count() == 0
    train, val = (S.read_corpus(spark, str(tmp_path / "shards"), s).count() for s in ("train", "val"))
    assert train + val == docs.count() and 0 < val < train


def test_conversation_lines(spark, tmp_path):
    good = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    lines = [json.dumps(good), "", json.dumps(good[:1]), json.dumps(good[::-1]), "{", json.dumps([good[0], {"role": "assistant"}])]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    rows = S.read_conversations_jsonl(spark, str(tmp_path / "c.jsonl")).collect()
    assert sorted(str(r["error"]) for r in rows) == ["None", "content", "not a list", "roles", "too short"]
    ok = S.read_conversations_jsonl(spark, str(tmp_path / "c.jsonl")).where("error is null")
    S.write_conversations(ok, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"conversations": good}


def test_questions(spark, tmp_path):
    (tmp_path / "q.csv").write_text("paper_id,question_id,question_text\n2,a,Why?\n,b,What?\n1,c,How?\n")
    assert [r["paper_id"] for r in S.read_questions(spark, str(tmp_path / "q.csv"), 1).collect()] == ["1"]
    try:
        require_columns(spark.range(1), ["id", "x"])
        raise AssertionError
    except ValueError as e:
        assert "missing columns: x" in str(e)


def test_logs_and_reports(spark, tmp_path):
    (tmp_path / "run1.log").write_text("step 1 val_bpb: 1.5\nstep 2 val_bpb: 1.25\nparams: 1,234,567\n")
    (tmp_path / "run2.log").write_text("nothing here\n")
    got = {r["file"]: (r["bpb"], r["params"]) for r in S.parse_run_logs(spark, str(tmp_path), {"bpb": "val_bpb", "params": "params"}).collect()}
    assert got == {"run1.log": (1.25, 1234567.0), "run2.log": (None, None)}
    r = S.parse_report(spark, str(tmp_path / "run1.log"), ["params", "CORE"]).collect()
    assert [(x["metric"], x["value"]) for x in r] == [("params", "1,234,567")]


def test_outputs(spark, tmp_path):
    S.write_outputs({"a": spark.range(3), "b": spark.range(2).select(F.array("id").alias("x"))}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == 3
    assert spark.read.json(str(tmp_path / "b")).count() == 2


def _records(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps({"entry_id": f"e{i}", "id": i, "title": f"t{i}", "full_text": f"Introduction\ntext {i}", "at": "2024-01-01T00:00:00Z"}) for i in rows))


def test_streams(spark, tmp_path):
    raw = tmp_path / "raw"
    _records(raw, "a.json", [1, 2, 2])
    run = lambda: I.stream_land(spark, str(raw), str(tmp_path / "bronze"), str(tmp_path / "cp")).awaitTermination()
    run()
    _records(raw, "b.json", [2, 3])
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "bronze")).collect()) == [1, 2, 3]
    I.stream_chunks(spark, str(raw), str(tmp_path / "chunks"), str(tmp_path / "cp2")).awaitTermination()
    once = chunk_corpus(spark.read.schema(I.RAW).json(str(raw)).dropDuplicates(["id"])).select("chunk_id")
    assert spark.read.parquet(str(tmp_path / "chunks")).select("chunk_id").distinct().exceptAll(once).count() == 0


def test_stream_lands_late_records(spark, tmp_path):
    raw = tmp_path / "raw"
    run = lambda: I.stream_land(spark, str(raw), str(tmp_path / "bronze"), str(tmp_path / "cp")).awaitTermination()
    _records(raw, "a.json", [1, 2])
    run()
    _records(raw, "b.json", [2, 3, 3])
    (raw / "b.json").write_text((raw / "b.json").read_text().replace("2024-01-01", "2020-01-01"))
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "bronze")).collect()) == [1, 2, 3]


def test_stream_history(spark, tmp_path):
    src = tmp_path / "turns"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"session": 1, "at": f"2024-01-0{i}T00:00:00Z", "role": "user", "text": str(i)}) for i in (3, 1, 2)))
    turns = spark.readStream.schema("session long, at timestamp, role string, text string").json(str(src))
    q = I.stream_history(turns, 2).writeStream.format("memory").queryName("history").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("history").collect()] == [(1, "USER: 2\nUSER: 3")]


def _papers(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_papers_without_arxiv_id_survive_and_histories_compact(spark, tmp_path):
    """Batches one by one: papers known by ss_id alone stay apart, one gets its arxiv_id later and is one paper still."""
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    run = lambda: I.stream_pipeline(spark, str(raw), out, str(tmp_path / "cp"), ("papers", "edges")).awaitTermination()
    _papers(raw, "a.json", [{"id": 1, "arxiv_id": "a1", "title": "one"}, {"id": 2, "ss_id": "s2", "title": "two"}, {"id": 3, "ss_id": "s3", "title": "three"}, {"id": 4, "title": "no ids"}])
    run()
    assert sorted(r["id"] for r in I.current_papers(spark, out).collect()) == [1, 2, 3, 4]
    _papers(raw, "b.json", [{"id": 20, "arxiv_id": "a2", "ss_id": "s2", "title": "two again"}, {"id": 5, "arxiv_id": "a5", "ss_id": "s5", "refs": [{"ss_paper_id": "s2"}, {"ss_paper_id": "s3"}, {"arxiv_id": "a1"}]}])
    run()
    for n in range(8):  # enough batches for a snapshot
        _papers(raw, f"c{n}.json", [{"id": 3, "ss_id": "s3", "title": f"three {n}"}, {"id": 100 + n, "ss_id": f"x{n}"}])
        run()
    now = {r["id"]: (r["arxiv_id"], r["ss_id"], r["title"]) for r in I.current_papers(spark, out).collect()}
    assert now == {1: ("a1", None, "one"), 2: ("a2", "s2", "two again"), 3: (None, "s3", "three 7"), 4: (None, None, "no ids"), 5: ("a5", "s5", None)} | {100 + n: (None, f"x{n}", None) for n in range(8)}
    snapshot, since = I.paper_history(spark, out).parts()
    assert snapshot == [7] and since == [8, 9]
    assert I.paper_history(spark, out).parts(before=5) == ([], [0, 1, 2, 3, 4])
    edges = I.current(spark, out + "/edges", ["source_id", "target_id", "kind"])
    assert {(r["source_id"], r["target_id"]) for r in edges.collect()} == {(5, 2), (5, 3), (5, 1)}


def test_landing_knows_keys_after_a_restart_and_what_stood_there(spark, tmp_path):
    raw, bronze = tmp_path / "raw", str(tmp_path / "bronze")
    I.stamped(spark.read.schema(I.RAW).json(spark.sparkContext.parallelize([json.dumps({"entry_id": "e1", "id": 1})]))).write.parquet(f"{bronze}/batch=-1")
    run = lambda: I.stream_land(spark, str(raw), bronze, str(tmp_path / "cp")).awaitTermination()
    for name, rows in (("a.json", [1, 2]), ("b.json", [2, 3]), ("c.json", [3, 1, 4, 4])):
        _records(raw, name, rows)
        run()
    got = spark.read.parquet(bronze)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4] and got.where("ingestion_id is null or ingested_at is null").count() == 0
    assert (tmp_path / "cp" / "state").exists() and "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
