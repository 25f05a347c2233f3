import datetime as dt

import pytest
from conftest import SF, SF2
from corpusmill.core.tables import table
from corpusmill.functions.wordform import word_sequence
from corpusmill.operators.snapshot_diff import p1_found, snapshot_changes
from pyspark.sql import functions as F


def brute(courses, grounding, headers):
    done = sorted((dt.datetime.fromisoformat(h["created_at"]), h["id"].strip().lower(), h["id"]) for h in headers if h["completed"])
    order = {key: i for i, (_, key, _) in enumerate(done)}
    out = []
    for name, rows in (("courses", courses), ("grounding_results", grounding)):
        at = "ingested_at" if name == "courses" else "created_at"
        state = [{} for _ in done]
        for r in sorted(rows, key=lambda r: r[at] or dt.datetime.min):
            s = order.get((r["snapshot_id"] or "?").strip().lower())
            if s is None:
                continue
            if name == "courses":
                key = f"{r['institution_id'] or ''}/" + "".join(c for c in (r["code"] or "").upper() if c.isalnum())
                value = (r["credits"], word_sequence(r["title"]), word_sequence(r["description"]))
            else:
                key = str(r["query_key"])
                value = ((r["route"] or "").strip(), frozenset(word_sequence(h["title"]) for h in r["hits"] or []))
            state[s][key] = value
        for i in range(1, len(done)):
            a, b = state[i - 1], state[i]
            out += [(name, done[i][2], k, "added") for k in b.keys() - a.keys()]
            out += [(name, done[i][2], k, "removed") for k in a.keys() - b.keys()]
            out += [(name, done[i][2], k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]]
    return sorted(out)


@pytest.mark.parametrize("sf", [SF, SF2])
def test_against_brute_force(spark, sf):
    frames = [table(spark, sf, n) for n in ("courses", "grounding_results", "knowledge_snapshots")]
    expected = brute(*([r.asDict(recursive=True) for r in f.collect()] for f in frames))
    got = sorted(tuple(r) for r in p1_found(*frames).select("record_table", "snapshot_id", "record_key", "change_kind").collect())
    assert got == expected and len(got) > 5


def test_nulls_ties_and_empty_tables(spark):
    c = "id string, snapshot_id string, institution_id string, program_id string, code string, title string, description string, credits double, ingested_at timestamp_ntz, k1 int"
    g = "result_id long, query_key long, route string, snapshot_id string, hits array<struct<title:string,content:string>>, created_at timestamp_ntz"
    h = "id string, created_at string, completed boolean"
    heads = spark.createDataFrame([("A", "2024-01-01T00:00:00+00:00", True), ("B", "2024-01-01T00:30:00-01:00", True), ("C", "2024-01-02T00:00:00+00:00", None), (None, None, True)], h)
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("1", " a", "i", None, "X 1", "One", None, 1.0, t, 0),
        ("2", "b ", "i", None, "x-1", "<b>ONE</b>", "&nbsp;", 1.0, t, 0),  # the same
        ("3", "B", None, None, None, None, None, None, None, 0),
        ("3", "B", None, None, None, None, None, None, None, 0),
        ("4", None, "i", None, "Z", "t", "d", 1.0, t, 0),
        ("5", "c", "i", None, "Z", "t", "d", 1.0, t, 0),
    ]
    ground = [(1, 7, None, "a", None, t), (2, 7, " ", "b", [], t), (3, None, "r", "b", [(None, "x")], t)]
    courses = spark.createDataFrame(rows, c)
    answers = spark.createDataFrame(ground, g)
    got = sorted(tuple(r) for r in p1_found(courses, answers, heads).collect())
    assert got == [("courses", "B", "/", "added"), ("grounding_results", "B", "", "added")]
    assert p1_found(courses.limit(0), answers.limit(0), heads).count() == 0
    assert p1_found(courses, answers, heads.limit(0)).count() == 0


def test_values_are_those_of_the_two_snapshots(spark):
    heads = spark.createDataFrame([(f"S{i}", f"2024-01-0{i}T00:00:00+00:00", True) for i in (1, 2, 3, 4)], "id string, created_at string, completed boolean")
    t = dt.datetime(2024, 1, 1)
    rows = [("a", f"S{i}", f"v{i}", t + dt.timedelta(i)) for i in (1, 2, 3)] + [("a", "S2", "late but older", t), ("b", "S2", "b2", t), ("b", "S3", "b2", t), ("c", "S3", None, None), ("a", "S9", "no snapshot", t), (None, "S1", "n", t)]
    df = spark.createDataFrame(rows, "k string, snapshot_id string, v string, ingested_at timestamp_ntz")
    got = sorted((tuple(r) for r in snapshot_changes(df, heads, F.col("k"), [F.col("v")], values=["v"]).collect()), key=str)
    assert got == sorted(
        [
            ("S2", "a", "changed", "v1", "v2"), ("S3", "a", "changed", "v2", "v3"), ("S4", "a", "removed", "v3", None), ("S2", "b", "added", None, "b2"), ("S4", "b", "removed", "b2", None),
            ("S3", "c", "added", None, None), ("S4", "c", "removed", None, None), ("S2", "", "removed", "n", None),
        ],
        key=str,
    )
