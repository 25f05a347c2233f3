import pytest
from conftest import SF
from corpusmill.core.tables import table
from corpusmill.functions.text import ROLE_TOKENS
from corpusmill.plans import evaluate, sync, training
from pyspark.sql import functions as F

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPECIALS = {t: 32000 + i for i, t in enumerate(ROLE_TOKENS.values())} | {"</s>": 2}


def test_sync_carries_over_and_publishes_last(spark, tmp_path):
    store = sync.SnapshotStore(spark, str(tmp_path / "store"))
    assert store.latest() is None
    page = lambda t: f"<title>T</title><body><p>{t}</p><script>{{\"title\": \"{t}\", \"description\": \"d\", \"code\": \"C 1\"}}</script></body>"
    first = spark.createDataFrame([("u1", "course", page("one")), ("u2", "faculty", page("two")), ("u3", "faculty", None)], "url string, page_type string, html string")
    a = sync.sync(store, first, "first", "2025-01-01T00:00:00+00:00")
    assert store.latest() == a and store.read("documents", a).count() == 2 and store.read("courses", a).count() == 2
    second = spark.createDataFrame([("u1", "course", page("changed")), ("u4", "course", page("new")), ("u2", "faculty", page("ignored"))], "url string, page_type string, html string")
    b = sync.sync(store, second, "second", "2025-02-01T00:00:00+00:00", ["course_catalog"])
    assert store.latest() == b and store.headers().where("is_current").count() == 1
    assert {r.url: r.status for r in store.diff(a, b).collect()} == {"u1": "changed", "u2": "unchanged", "u4": "added"}
    chunks = store.read("chunks", b)
    ids = {r.id for r in store.read("documents", b).collect()}
    assert {r.document_id for r in chunks.collect()} == ids and not ids & {r.id for r in store.read("documents", a).collect()}

    class Broken:
        def where(self, *_):
            raise RuntimeError("no pages")

    with pytest.raises(RuntimeError):
        sync.sync(store, Broken(), "third", "2025-03-01T00:00:00+00:00")
    assert store.latest() == b and store.headers().count() == 3


def test_example_stages(spark, tmp_path):
    sft = training.encoded_sft(table(spark, SF, "sft_examples"), PIECES, SPECIALS, 128, 0)
    target = f"file://{tmp_path}/sft"
    m = training.write_stage(sft, "sft", target, rows_per_shard=16)
    rows = spark.read.parquet(target)
    assert m["rows"] == rows.count() == sft.count() and rows.groupBy("shard").count().agg(F.max("count")).first()[0] == 16
    assert rows.where("size(input_ids) <> 128 or size(labels) <> 128").count() == 0
    assert training.write_stage(sft.limit(0), "sft", target, rows_per_shard=16) == m
    p = training.encoded_preferences(table(spark, SF, "preference_examples"), PIECES, SPECIALS, 64, 0)
    assert p.count() > 5 and p.where("size(chosen_ids) <> 64 or size(rejected_ids) <> 64").count() == 0


def test_benchmark_run(spark):
    schema = "domain string, response string, expects_abstention boolean, expected_substrings array<string>, hit boolean"
    items = spark.createDataFrame([("a", "Yes [source: x]", False, ["yes"], True), ("a", "no", False, ["yes"], False), ("b", "I don't know", True, None, False), ("b", "Sure it is", True, None, False)], schema)
    s = evaluate.scored(items)
    got = {r.domain: (r.examples, r.exactness, r.citation_rate, r.abstention_rate, r.warned) for r in evaluate.summary(s, ["domain"]).collect()}
    assert got == {"a": (2, 0.5, 0.5, 0.0, True), "b": (2, 0.5, 0.0, 0.5, True)}
    audit = evaluate.retrieval_audit(s, F.lit(True), F.col("hit"), ~F.col("expects_abstention"), ~F.col("abstained")).first()
    assert (audit.present_queries, audit.retrieval_false_negatives, audit.true_missing_rate, audit.hallucination_rate) == (2, 1, 0.5, 0.5)
    r = spark.createDataFrame([(["x"], ["x", "y"], "x"), (["z"], ["x"], "x"), (["chat"], ["chat"], "chat")], "e array<string>, f array<string>, r string")
    audit = evaluate.route_audit(r, "e", "f", "r").first()
    assert (audit.expected_grounded_queries, audit.route_true_positives, audit.route_false_negatives, audit.mismatched_routes, audit.route_false_negative_rate) == (2, 1, 1, 1, 0.5)
    assert evaluate.route_audit(r.limit(0), "e", "f", "r").first().route_false_negative_rate is None
    both = evaluate.compared(evaluate.summary(s, ["domain"]), evaluate.summary(s, ["domain"]), "domain", ["exactness", "citation_rate"])
    assert {r.delta for r in both.collect()} == {0.0}
