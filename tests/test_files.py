import json
import random

import pytest
from corpusmill.operators import corpus
from corpusmill.sources import files
from corpusmill.streaming import incremental


def test_bytes_pages_and_hashes(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.html").write_bytes("é <p>x</p>".encode())
    (tmp_path / "in/sub/b.html").write_bytes("é".encode("latin-1"))
    (tmp_path / "in/c.txt").write_text("no page")
    assert sorted(r.html for r in files.page_files(spark, str(tmp_path / "in")).collect()) == ["é", "é <p>x</p>"]
    one = files.folder_hash(spark, str(tmp_path / "in"))
    (tmp_path / "in/c.txt").write_text("changed")
    assert one != files.folder_hash(spark, str(tmp_path / "in")) and files.file_hashes(spark, str(tmp_path / "in")).count() == 3


def test_fetching_keeps_failures(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("gone")
        return b"<p>" + url.encode()

    got = {r.url: (r.html, r.error) for r in files.fetched(spark.createDataFrame([("a", 1), ("bad", 2)], "url string, k int"), fetch).collect()}
    assert got == {"a": ("<p>a", None), "bad": (None, "OSError: gone")}


def test_json_that_grows(spark, tmp_path):
    p = str(tmp_path / "h")
    for k in range(2):
        files.append_json(spark.createDataFrame([(k, "x")], "k int, v string"), p)
    assert spark.read.json(p).count() == 2
    (tmp_path / "b.jsonl").write_text(json.dumps({"a": 1}) + "\n\n" + json.dumps({"a": 2}) + "\n")
    assert files.count_examples(spark, str(tmp_path / "b.jsonl")).first().examples == 2


def test_fallback():
    def bad():
        raise RuntimeError("no")

    assert files.or_last_completed(lambda: "n", lambda: "o") == ("n", None) and files.or_last_completed(bad, lambda: "o") == ("o", "RuntimeError: no")
    with pytest.raises(RuntimeError):
        files.or_last_completed(bad, lambda: None)


def test_streamed_packing_groups_like_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i % 2, i, rng.choice([3, 20, 60, 99, 100, 130, 250])) for i in range(200)]
    df = spark.createDataFrame(rows, "lane long, ord long, n long")
    for k in range(4):  # one file a micro-batch, in order
        df.where(f"ord >= {50 * k} and ord < {50 * k + 50}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    incremental.run_available(incremental.pack_stream(stream, 100), str(tmp_path / "out"), str(tmp_path / "cp"))

    def groups(frame):
        by = {}
        for r in frame.collect():
            by.setdefault((r.lane, r.row), []).append((r.ord, r.offset, r.part))
        return sorted((k[0], sorted(v)) for k, v in by.items())

    assert groups(spark.read.parquet(str(tmp_path / "out"))) == groups(corpus.next_fit(df, 100))
