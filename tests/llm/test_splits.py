from collections import Counter, defaultdict

from conftest import SF, SF2
from corpusmill.llm import splits
from corpusmill.llm.queries import SHARES, _examples


def brute(tables):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sources = defaultdict(set)
    recs = set()
    for name, df in tables.items():
        for r in df.collect():
            rec = (name, r.example_id)
            recs.add(rec)
            m = r.metadata or {}
            for kind, v in (("s", r.source), ("g", r.split_group_id), ("a", m.get("author")), ("e", m.get("entity"))):
                if v is not None and kind != "s":
                    v = v.strip().lower()
                    v = None if v in splits.STAND_INS else v
                if v is not None:
                    parent[root(rec)] = root((kind, v))
            if r.source is not None:
                sources[rec].add(r.source)
    by = defaultdict(set)
    for rec in recs:
        by[root(rec)] |= sources[rec]
    return {rec: root(rec) for rec in recs}, {(*rec, min(by[root(rec)])) for rec in recs if len(by[root(rec)]) > 1}


def test_mixed_groups_equal_union_find(spark):
    for sf in (SF, SF2):
        tables = _examples(spark, sf)
        assert {tuple(r) for r in splits.mixed_groups(tables).select("record_table", "example_id", "group_source").collect()} == brute(tables)[1]


def test_splits_keep_groups_and_shares(spark):
    tables = _examples(spark, SF2)
    rows = splits.assign_splits(tables, {"train": 0.5, "validation": 0.25, "test": 0.25}).collect()
    roots, _ = brute(tables)
    assert {(r.record_table, r.example_id) for r in rows} == set(roots) and len(rows) == len(roots)
    per = defaultdict(set)
    for r in rows:
        per[roots[r.record_table, r.example_id]].add(r.split)
    assert all(len(s) == 1 for s in per.values())
    n = Counter(r.split for r in rows)
    assert abs(n["validation"] / len(rows) - 0.25) < 0.2 and len(SHARES) == 3


def test_long_chain_is_one_component(spark):
    import random

    ids = list(range(300))
    random.Random(2).shuffle(ids)
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(299)] + [(1000, 1000), (2000, 2001)], "a long, b long")
    got = {r.node: r.root for r in splits.components(edges).collect()}
    assert {got[i] for i in ids} == {0} and got[1000] == 1000 and got[2001] == 2000


def test_allocation_is_whole_and_near_quota():
    counts = splits.allocate([(1, (1, 0), 500), (3, (2, 1), 100), (40, (20, 20), 3)], [0.8, 0.1, 0.1])
    assert [sum(c) for c in counts] == [500, 100, 3]
    sizes = [sum(c[s] * b for c, b in zip(counts, (1, 3, 40))) for s in range(3)]
    assert abs(sizes[0] - 736) <= 20 and abs(sizes[1] - 92) <= 20
    # a bundle of components of about one size has their mean
    mean = splits.allocate([(1, (1, 0), 500), (31.5, (2, 1), 20)], [0.8, 0.1, 0.1])
    assert [sum(c) for c in mean] == [500, 20] and abs(sum(c[0] * b for c, b in zip(mean, (1, 31.5))) - 904) <= 32


def test_empty_null_and_blank(spark):
    schema = "example_id string, source string, split_group_id string, metadata map<string,string>, node int"
    a = spark.createDataFrame([("x", None, None, None, 1), ("y", "s", " N/A ", {"author": "Ann"}, 1), ("y", "s", None, None, 1), ("z", "t", None, {"author": " ann\t"}, 1), (None, "t", None, None, 1)], schema)
    got = {tuple(r) for r in splits.mixed_groups({"a": a}).collect()}
    assert got == {("a", "y", "s"), ("a", "z", "s")}
    assert splits.mixed_groups({"a": a.limit(0)}).count() == 0
    assert splits.assign_splits({"a": a.limit(0)}, SHARES).count() == 0
    assert splits.assign_splits({"a": a}, SHARES).count() == 3
