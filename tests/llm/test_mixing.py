from conftest import SF2
from corpusmill.llm import mixing
from corpusmill.llm.queries import _mix
from pyspark.sql import functions as F


def test_shares_epochs_and_caps(spark):
    mix, report = _mix(spark, SF2)
    rows = {r.source: r for r in report.collect()}
    by = {r.source: r for r in mix.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("s"), F.max("copies").alias("hi"), F.min("copies").alias("lo")).collect()}
    caps = {r.name: r.max_records for r in spark.read.parquet(f"{SF2}/data_sources.parquet").collect()}
    assert len(rows) == 36 and abs(sum(r.actual_share for r in rows.values()) - 1) < 1e-9
    for name, r in by.items():
        assert r.s == rows[name].drawn_size and r.hi <= 4 and r.hi - r.lo <= 1
        assert caps[name] is None or r.n <= caps[name]
    for r in rows.values():
        if not r.weight:
            assert r.drawn_size == 0 and r.target_share == 0


def test_budgets_water_fill():
    plan = mixing.budgets([("a", 1.0, 10), ("b", 1.0, 1000), ("c", None, 50), ("d", 2.0, 0)], 400, 4)
    assert plan["a"] == (0.25, 40) and plan["b"] == (0.25, 360) and plan["c"][1] == 0 and plan["d"] == (0.5, 0)


def test_matches_plain_sort(spark):
    docs = spark.createDataFrame([(i, "s" if i % 3 else "t", 1 + i % 7) for i in range(500)], "doc_id long, source string, n int")
    conf = spark.createDataFrame([("s", 1.0, None, 1), ("t", 3.0, 100, 1)], "name string, weight double, max_records long, key int")
    mix, report = mixing.mix(docs, conf, F.col("n"), F.lit(1.0), total=900)
    keyed = {(r.source, r.doc_id): (r.key, r.size) for r in mixing.keyed(docs, F.col("n"), F.lit(1.0), 17).collect()}
    got = {(r.source, r.doc_id): r.copies for r in mix.collect()}
    for source, cap in (("s", 10**9), ("t", 100)):
        order = sorted((k, d, s) for (x, d), (k, s) in keyed.items() if x == source)[:cap]
        pool = sum(s for *_, s in order)
        budget = next(r.drawn_size for r in report.collect() if r.source == source)
        want, run = {}, 0
        goal = min({"s": 225, "t": 675}[source], 4 * pool)
        for _, d, s in order:
            run += s
            want[source, d] = goal // pool + (run <= goal % pool)
        want = {k: v for k, v in want.items() if v}
        assert {k: v for k, v in got.items() if k[0] == source} == want and abs(budget - goal) <= 7


def test_empty(spark):
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")
    conf = spark.createDataFrame([("s", 1.0, None), (None, 2.0, None)], "name string, weight double, max_records long")
    mix, report = mixing.mix(docs, conf, F.coalesce(F.length("text"), F.lit(0)), F.lit(1.0))
    assert mix.count() == 0 and [(r.source, r.drawn_size, r.actual_share) for r in report.collect()] == [("s", 0, 0.0)]
    assert mixing.mix(docs.limit(0), conf.limit(0), F.lit(1), F.lit(1.0))[1].count() == 0
