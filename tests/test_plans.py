import json

import pyarrow as pa
import pytest
from conftest import SF
from corpusmill.core.tables import table
from corpusmill.plans import prepare
from corpusmill.sources import readers
from corpusmill.streaming import incremental
from pyspark.sql import functions as F


def test_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    (tmp_path / "a.jsonl").write_text('{"text": "x", "n": 1}\n{"text": null}\n')
    batches = pa.table({"text": ["p", "q", None], "k": [1, 2, 3]})
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, batches.schema) as w:
        w.write_table(batches, max_chunksize=2)
    table_ = spark.createDataFrame([("z",)], "text string")
    table_.write.parquet(str(tmp_path / "a.parquet"))
    read = lambda f, n: [r.text for r in readers.read_records(spark, f, str(tmp_path / n)).select("text").collect()]
    assert read("text", "a.txt") == ["one", "", "two"] and read("jsonl", "a.jsonl") == ["x", None]
    assert sorted(x or "" for x in read("arrow", "a.arrow")) == ["", "p", "q"] and read("parquet", "a.parquet") == ["z"]
    with pytest.raises(ValueError, match="unknown format"):
        readers.read_records(spark, "prepared", "x")
    with pytest.raises(ValueError, match="needs a path"):
        readers.read_records(spark, "text", None)
    assert readers.text_column(spark.range(1)).first().text == "" and readers.text_column(readers.read_records(spark, "jsonl", str(tmp_path / "a.jsonl"))).count() == 1


def test_entries_pages_and_scripts(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"rules": [{"contains": "x"}, 3]}))
    assert readers.entries(p, ("rules", "other")) == [{"contains": "x"}] and readers.entries(tmp_path / "none", ("a",)) == []
    rows = spark.createDataFrame([(1, "head\n=== Page 1 ===\nfirst\n=== Page 2 ===\n second \n"), (2, "none")], "id int, text string")
    assert [(r.id, r.page, r.page_text) for r in readers.marked_pages(rows).collect()] == [(1, 1, "first"), (1, 2, "second")]
    pages = spark.createDataFrame([(1, '<script type="application/json">{"a": {"b": 1}, "c": [{"d": 2}]}</script><script>x()</script>'), (2, "<script>[{&quot;e&quot;: 3}]</script>"), (3, None)], "id int, page string")
    got = sorted((r.id, r.object) for r in readers.script_objects(pages, "page").collect())
    assert got == [(1, '{"a": {"b": 1}, "c": [{"d": 2}]}'), (1, '{"b": 1}'), (1, '{"d": 2}'), (2, '{"e": 3}')]


def test_prepare_writes_once_and_reuses(spark, tmp_path):
    docs, conf = table(spark, SF, "documents"), table(spark, SF, "data_sources")
    target = f"file://{tmp_path}/out"
    first = prepare.prepare(docs, conf, target, budget=20_000, rows_per_shard=10, inputs={"v": 1})
    rows = prepare.read_prepared(spark, target)
    assert rows.count() == first["rows"] and first["shards"] == -(-first["rows"] // 10) and first["size"] >= 20_000
    assert rows.groupBy("clean_text").count().where("count > 1").join(rows, "clean_text").count() <= rows.count()
    assert prepare.prepare(docs, conf, target, budget=20_000, rows_per_shard=10, inputs={"v": 1}) == first
    with pytest.raises(ValueError):  # other documents are another stage
        prepare.prepare(docs.limit(0), conf, target, budget=20_000, rows_per_shard=10, inputs={"v": 1})
    with pytest.raises(ValueError, match="another stage"):
        prepare.prepare(docs, conf, target, budget=20_000, rows_per_shard=10, inputs={"v": 2})
    assert prepare.prepare(docs, conf, target, rows_per_shard=10, inputs={"v": 2}, force=True)["rows"] > first["rows"]
    with pytest.raises(ValueError, match="no complete"):
        prepare.read_prepared(spark, f"file://{tmp_path}/nothing")


def test_streamed_dedup_equals_batch(spark, tmp_path):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), docs.schema, files_per_batch=1)
    incremental.run_available(incremental.dedup_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = incremental.dedup_stream(docs)
    assert got.count() == batch.count() and got.select("text_hash").exceptAll(batch.select("text_hash")).count() == 0
    # a second run has only what came later
    docs.limit(5).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.run_available(incremental.dedup_stream(incremental.file_stream(spark, str(tmp_path / "in"), docs.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == got.count()


def test_windows_and_sessions(spark, tmp_path):
    events = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), events.schema)
    incremental.run_available(incremental.windowed_counts(stream, "ts", "event_type", "value"), str(tmp_path / "w"), str(tmp_path / "c1"))
    got = spark.read.parquet(str(tmp_path / "w"))
    whole = incremental.windowed_counts(events, "ts", "event_type", "value")
    assert 0 < got.count() <= whole.count() and got.select("start", "event_type", "n").exceptAll(whole.select("start", "event_type", "n")).count() == 0
    assert incremental.sessions(events, "ts", "user_id").agg(F.sum("n")).first()[0] == events.count()
