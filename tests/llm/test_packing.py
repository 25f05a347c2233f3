import random
from collections import Counter

from corpusmill.llm.packing import best_fit, pack, sweep


def test_no_container_overflows_and_waste_is_small(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([7, 40, 40, 40, 333, rng.randint(1, 1500)])) for i in range(3000)] + [(9000, 0), (9001, None), (9002, 5000), (9003, 2000)]
    rows = pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), 1000).collect()
    fill = Counter()
    for r in rows:
        if r.container_id is not None:
            fill[r.container_id] += r.n_tokens
    assert max(fill.values()) <= 1000
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
    assert dict(total) == {i: n or 0 for i, n in sizes}
    split = {r.doc_id for r in rows if r.part}
    assert all(n > 1000 for i, n in sizes if i in split)
    assert sum(fill.values()) / (1000 * len(fill)) > 0.99
    assert len({(r.doc_id, r.part) for r in rows}) == len(rows)


def _containers(histogram, capacity):
    gaps = []
    for s in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        at = min((g for g in range(len(gaps)) if gaps[g] >= s), key=lambda g: gaps[g], default=None)
        if at is None:
            gaps.append(capacity)
            at = len(gaps) - 1
        gaps[at] -= s
    return len(gaps)


def _check(histogram, capacity, ranges):
    fill, seen = Counter(), Counter()
    for size, rank, n, first in ranges:
        for k in range(n):
            fill[first + k] += size
            seen[size, rank + k] += 1
    assert max(fill.values()) <= capacity
    assert set(seen) == {(s, r) for s, n in histogram.items() for r in range(n)} and set(seen.values()) == {1}
    return len(fill)


def test_a_sweep_over_empty_containers_is_best_fit_one_at_a_time():
    rng = random.Random(1)
    for _ in range(50):
        histogram = {s: rng.randint(1, 9) for s in rng.sample(range(1, 60), 12)}
        items, _, placed = sweep([(s, 0, n) for s, n in histogram.items()], [(60, 0, 500)])
        assert not items and _check(histogram, 60, placed) == _containers(histogram, 60)


def test_supersteps_need_no_more_containers_than_best_fit(spark):
    rng = random.Random(2)
    for top in (60, 25):
        histogram = {s: rng.randint(1, 40) for s in rng.sample(range(1, top), 15)}
        ranges = best_fit(spark.createDataFrame(list(histogram.items()), "size int, count long"), 60).collect()
        assert _check(histogram, 60, [tuple(r) for r in ranges]) <= _containers(histogram, 60) + 1
    assert best_fit(spark.createDataFrame([], "size int, count long"), 60).count() == 0


def test_empty_and_repeated(spark):
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 10).count() == 0
    rows = pack(spark.createDataFrame([(1, 4)] * 5 + [(2, 25)], "doc_id long, n_tokens long"), 10).collect()
    fill = Counter()
    for r in rows:
        fill[r.container_id] += r.n_tokens
    assert sum(fill.values()) == 45 and max(fill.values()) <= 10 and len(rows) == 8
