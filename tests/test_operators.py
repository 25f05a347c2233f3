import random

import pytest
from corpusmill.operators import corpus, evals, examples, retrieval, snapshots
from pyspark.sql import functions as F


def test_running_and_budgets_equal_a_loop(spark):
    rng = random.Random(1)
    rows = [(k * 7 + rng.randint(0, 6), rng.randint(0, 50)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, n long")
    got = {r.id: r.before_n for r in corpus.running(df, ["n"], "id", n_ranges=13).collect()}
    total = 0
    for i, n in sorted(rows):
        assert got[i] == total
        total += n
    kept = {r.id for r in corpus.budget_prefix(df, {"n": 1000}, "id").collect()}
    run, want = 0, set()
    for i, n in sorted(rows):
        if run >= 1000:
            break
        want.add(i)
        run += n
    assert kept == want
    assert corpus.budget_prefix(df.limit(0), {"n": 5}, "id").count() == 0


def next_fit(sizes, capacity):
    """Sequences of (document, tokens) the sequential way."""
    out, current, used = [], [], 0
    for i, n in sizes:
        if n > capacity:
            out += [[(i, min(capacity, n - k))] for k in range(0, n, capacity)]
            continue
        if used + n > capacity:
            out.append(current)
            current, used = [], 0
        current.append((i, n))
        used += n
    return [*out, current] if current else out


def test_next_fit(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([1, 5, 20, 60, 99, 100, 101, 250])) for i in range(400)]
    df = spark.createDataFrame([(i, n, 0) for i, n in sizes], "ord long, n long, lane long")
    got = {}
    for r in corpus.next_fit(df, 100).collect():
        got.setdefault(r.row, []).append((r.offset, r.ord))
    want = next_fit(sizes, 100)
    assert [[o for _, o in sorted(got[k])] for k in sorted(got)] == [[i for i, _ in row] for row in want]
    assert corpus.next_fit(df.limit(0), 100).count() == 0
    lanes = corpus.next_fit(df.withColumn("lane", F.col("ord") % 4), 100).groupBy("lane").count().collect()
    assert len(lanes) == 4


def test_dedup_first_wins_and_exceptions(spark):
    rows = spark.createDataFrame([(3, "a", True), (1, "a", True), (2, "a", False), (4, None, True), (5, "b", True)], "doc_id int, t string, dd boolean")
    kept = {r.doc_id for r in corpus.exact_dedup(rows.where("t is not null"), "t", [F.col("doc_id")], F.col("dd")).collect()}
    assert kept == {1, 2, 5}
    assert {r.doc_id for r in corpus.dedup_against(rows.where("dd"), rows.where("not dd"), "t").collect()} == {4, 5}


def test_cleaning_switches(spark):
    docs = spark.createDataFrame([(1, "call 212-555-0134 " + "word " * 40, "a"), (2, "call 212-555-0134 " + "word " * 40, "b"), (3, "short", "a"), (4, "short", "b"), (5, None, "a"), (6, "short", None)], "doc_id int, text string, source string")
    conf = spark.createDataFrame([("a", True, True, True), ("b", False, None, False), (None, True, True, True)], "name string, quality_filter boolean, deduplicate boolean, pii_scrub boolean")
    got = {r.doc_id: (r.dropped_reason, "[PHONE]" in r.clean_text) for r in corpus.clean(docs, conf).collect()}
    assert got == {1: (None, True), 2: (None, False), 3: ("quality_filter", False), 4: (None, False), 6: ("quality_filter", False)}


def test_windows_unions_pads(spark):
    df = spark.range(10).withColumnRenamed("id", "ord")
    assert corpus.record_window(df, F.col("ord"), 3, 4).count() == 4 and corpus.record_window(df, F.col("ord"), -1, None).count() == 10
    assert corpus.resumed_window(5, 10, 4) == (9, 6) and corpus.resumed_window(5, None, 4) == (9, None) and corpus.resumed_window(0, 3, 9) == (9, 0)
    both = corpus.union_sources([df, df.withColumn("x", F.lit(1))])
    assert both.count() == 20 and both.where("source_idx = 1 and x = 1").count() == 10
    r = spark.createDataFrame([([1, 2, 3],)], "ids array<int>").select(corpus.pad(F.col("ids"), 5, 0).alias("p"), corpus.pad(F.col("ids"), 2, 0).alias("q"), corpus.masked_labels(corpus.pad(F.col("ids"), 4, 0), 0).alias("m")).first()
    assert (r.p, r.q, r.m) == ([1, 2, 3, 0, 0], [1, 2], [1, 2, 3, -100])


def test_group_split_is_disjoint_and_covers(spark):
    rows = spark.createDataFrame([(i, f"g{i % 23}") for i in range(300)], "i int, g string")
    out = examples.group_split(rows, "g", 0.2, least=5).collect()
    assert len(out) == 300
    sides = {}
    for r in out:
        sides.setdefault(r.g, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values())
    n = sum(r.split == "validation" for r in out)
    assert 60 <= n < 80
    assert {r.split for r in examples.group_split(rows, "g", 5.0).collect()} == {"train", "validation"}  # one group stays
    assert {r.split for r in examples.group_split(rows, "g", 0.0).collect()} == {"train"}
    assert examples.group_split(rows.limit(0), "g", 0.2).count() == 0


def test_ids_and_overlap(spark):
    schema = "id string, alt string, source string, messages array<struct<role:string,content:string>>"
    rows = spark.createDataFrame([(" a ", "b", "s", [("user", "x")]), (" ", None, "s", [("user", "x"), ("assistant", "y")]), (None, None, "s", [("user", " x ")]), ("n", None, None, None)], schema)
    ids = [r.g for r in rows.select(examples.group_id([F.col("id"), F.col("alt")], F.col("source"), F.col("messages")).alias("g")).collect()]
    assert ids[0] == "a" and ids[1] == ids[2] and len(ids[1]) == 64 and ids[3] == "n"
    assert examples.overlap(rows, rows.limit(1)).count() == 3
    left = spark.createDataFrame([("k", "a", 0, 5), ("k", "b", 5, None)], "k string, name string, start long, stop long")
    right = spark.createDataFrame([("k", "c", 4, 6), ("j", "d", 0, None)], "k string, name string, start long, stop long")
    assert {(r.left_name, r.right_name) for r in examples.range_overlaps(left, right, "k").collect()} == {("a", "c"), ("b", "c")}


def test_upsert_publish_diff(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, None, 0), (None, "z", 0)], "id int, v string, seq int")
    after = snapshots.upsert(old, new, ["id"], "seq")
    assert {(r.id, r.v) for r in after.collect()} == {(1, "a"), (2, "d"), (3, None), (None, "z")}
    status = {r.id: r.status for r in snapshots.diff(old, after.where("id is not null and id <> 1"), "id", "v").collect()}
    assert status == {1: "removed", 2: "changed", 3: "added"}
    heads = spark.createDataFrame([("a", "2024", True, True), ("b", "2025", True, False), ("c", "2026", None, None)], "id string, created_at string, completed boolean, is_current boolean")
    assert snapshots.latest_snapshot(heads).first().id == "a"
    assert snapshots.latest_snapshot(snapshots.publish(heads, "c")).first().id == "c"
    assert snapshots.publish(heads, "c").where("is_current").count() == 1
    assert snapshots.latest_snapshot(heads.drop("is_current").withColumn("is_current", F.lit(None).cast("boolean")), False).first().id == "c"


def test_policy_and_url(spark):
    pages = spark.createDataFrame([(1, "The FACULTY page"), (2, None), (3, "other")], "id int, t string")
    rules = spark.createDataFrame([("page", "b", 1), ("faculty", "a", 0), (" ", "never", 2)], "needle string, page_type string, ord int")
    assert {r.id: r.page_type for r in snapshots.first_policy(pages, rules, F.col("t"), "id").collect()} == {1: "a", 2: "generic", 3: "generic"}
    urls = spark.createDataFrame([("https://x/course-catalog/faculty",), ("https://x/tuition",), (None,)], "u string")
    assert [r.p for r in urls.select(snapshots.url_page_type(F.col("u")).alias("p")).collect()] == ["course", "admissions", "generic"]


def test_search_is_stable_and_counts_like_python(spark):
    docs = [(i, " ".join(random.Random(i).choice(["tidal", "energy", "wave", "clay", "form"]) for _ in range(6))) for i in range(200)]
    rows = spark.createDataFrame([*docs, (500, None), (501, "")], "ord int, body string")
    asked = spark.createDataFrame([(1, "tidal energy"), (2, " ")], "qid int, query string")
    got = [(r.ord, r.score) for r in retrieval.search(asked, rows, retrieval.lexical_score, ["body"], 7).orderBy("rank").collect()]
    want = sorted(((o, 8.0 * ("tidal energy" in b) + 1.5 * len({"tidal", "energy"} & set(b.split()))) for o, b in docs), key=lambda x: (-x[1], x[0]))[:7]
    assert got == want
    fuzzy = retrieval.search(asked, rows, retrieval.fuzzy_score, ["body"], 3).collect()
    assert len(fuzzy) == 3 and all(r.score > 0 for r in fuzzy)


def test_routing_rules(spark):
    rules = [("b", 4, ["cat"]), ("a", 4, ["dog"]), ("c", 3, ["cat"])]
    rows = spark.createDataFrame([("Cat and dog",), ("concatenate",), ("dog",), ("none",), (None,)], "t string")
    got = [r.r for r in rows.select(retrieval.route(F.col("t"), rules).alias("r")).collect()]
    assert [(r.route, r.low_confidence, r.fanout) for r in got] == [("b", True, ["b", "a"]), ("b", True, ["b", "c"]), ("a", False, ["a"]), ("chat", False, []), ("chat", False, [])]
    terms = spark.createDataFrame([("is cs-101a open?",)], "t string").select(retrieval.course_code_terms(F.col("t")).alias("x")).first().x
    assert terms == ["cs-101a", "CS 101A", "CS101A", "is cs-101a open?"]


def test_ordered_hits(spark):
    hits = spark.createDataFrame([(1, 3, "a", 0), (1, 1, "b", 0), (1, 2, "a", 0), (2, 1, "c", 1), (2, 2, "c", 0)], "qid int, ord int, k string, stage_rank int")
    assert sorted((r.qid, r.ord) for r in retrieval.ordered_distinct(hits, ["k"], "ord", 1, ["qid"]).collect()) == [(1, 1), (2, 1)]
    assert sorted((r.qid, r.ord) for r in retrieval.first_stage(hits).collect()) == [(1, 1), (1, 2), (1, 3), (2, 2)]
    ranked = hits.withColumn("rank", F.col("ord"))
    assert sorted((r.qid, r.ord) for r in retrieval.prefer_titles(ranked, F.col("k") == "a", 5).collect()) == [(1, 2), (1, 3), (2, 1), (2, 2)]


def test_gates_and_rates(spark):
    m = spark.createDataFrame([("x", 0.9), ("y", 0.2)], "metric string, value double")
    t = spark.createDataFrame([("x", "minimum", 0.9), ("y", "maximum", 0.1), ("z", "equal", 1.0)], "metric string, kind string, threshold double")
    gated = evals.gates(m, t)
    assert {r.metric: r.passed for r in gated.collect()} == {"x": True, "y": False, "z": False}
    assert not evals.all_passed(gated).first().passed and evals.all_passed(gated.limit(0)).first().passed
    empty = m.limit(0).agg(evals.rate(F.col("value") > 0).alias("r"), evals.weighted_mean("value", "value").alias("w"), evals.guarded(F.sum("value"), F.count("value")).alias("g")).first()
    assert (empty.r, empty.w, empty.g) == (0.0, 0.0, None)
    r = spark.createDataFrame([("lol lol lol a, b!!! x-",)], "t string").select(*(c.alias(n) for n, c in evals.generation_quality(F.col("t")).items())).first()
    assert r.repeated_token_run == 3 and r.tokens == 6 and r.unique_token_ratio == pytest.approx(4 / 6, abs=1e-4)


def test_answer_scores(spark):
    schema = "r string, ref string, exp array<string>, bad array<string>, cite boolean"
    rows = spark.createDataFrame(
        [("yes", " yes ", None, None, None), ("A and B", None, ["a", "c"], ["b"], None), ("a [Source: x]", None, ["a"], [], True), ("a", None, ["a"], None, True), ("how can I help today", None, None, None, None), ("a !!!!! b", "a !!!!! b", ["a"], None, None), (None, "x", None, None, None)], schema
    )
    got = [r.s for r in rows.select(evals.answer_score(F.col("r"), F.col("ref"), F.col("exp"), F.col("bad"), F.col("cite")).alias("s")).collect()]
    assert got == [1.0, 0.0, 1.5, 0.5, 0.0, 0.0, 0.0]
    g = spark.createDataFrame([("A b", False, ["a", "b"], None), ("A b", False, ["a", "c"], None), ("x", None, None, ["y", "x"]), (" ", None, None, None), ("I don't know.", True, ["a"], None), ("", True, None, None)], "r string, abst boolean, every array<string>, some array<string>")
    assert [r.e for r in g.select(evals.grounded_exact(F.col("r"), F.col("abst"), [F.col("every")], F.col("some")).alias("e")).collect()] == [True, False, True, False, True, False]
    t = spark.createDataFrame([("a b c " * 10,), ("word " * 12,), ("plain words in a normal sentence",), (",,,, .... ///",), (None,)], "t string")
    assert [r.x for r in t.select(evals.degenerate_reasons(F.col("t")).alias("x")).collect()] == [["too_many_short_fragments", "low_token_variety"], ["repeated_token_burst", "low_token_variety"], [], ["separator_spam"], []]


def test_runs_of_any_length_are_seen(spark):
    # literals are evaluated in the driver: an overflown stack fails the test, not the session
    for unit, least, n_marks, n_words in (("!", 5, 1, 0), ("? \n ", 5, 1, 0), ("and ", 4, 0, 1), ("Or\t", 4, 0, 1)):
        for n in (least - 1, least, least + 1, 200_000):
            t = F.lit("x " + unit * n)
            got = spark.sql("SELECT 1").select(evals.repeated_marks(t).alias("m"), evals.repeated_connectors(t).alias("c"), evals.answer_score(t, F.lit("y"), F.array(F.lit("x"), F.lit("no"))).alias("s")).first()
            assert got == (n_marks and n >= least, n_words and n >= least, 0.0 if n >= least else 0.5), (unit, n)
    blanks = F.lit(", " + " " * 300_000 + ",,,. ,,")
    assert spark.sql("SELECT 1").select(evals.repeated_marks(blanks)).first()[0] is False


def test_early_stopping_fold(spark):
    h = spark.createDataFrame([("r", 1, 2.0), ("r", 2, 1.95), ("r", 3, None), ("r", 4, 2.5), ("r", 5, 1.0), ("q", 1, None)], "run string, step int, loss double")
    got = {(r.run, r.step): (r.best, r.best_step, r.no_improvement, r.worsening) for r in evals.early_stopping(h, "run", "step", "loss", 0.1).collect()}
    assert got[("r", 2)] == (2.0, 1, 1, 0) and got[("r", 3)] == (2.0, 1, 1, 0) and got[("r", 4)] == (2.0, 1, 2, 1) and got[("r", 5)] == (1.0, 5, 0, 0) and got[("q", 1)] == (None, None, 0, 0)
