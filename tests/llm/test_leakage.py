import re
import unicodedata

from conftest import SF2
from corpusmill.llm import leakage
from corpusmill.llm.queries import _items
from corpusmill.core.tables import table


def fold(text):
    text = re.sub(r"(?<=[^\W\d_])[-‐‑­][^\S\r\n]*(?:\r\n|\r|\n)[^\S\r\n]*(?=[^\W\d_])", "", text)
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf"))
    return re.findall("[a-z0-9]+", text.lower())


def brute(items, docs):
    texts = [(d.doc_id, " " + " ".join(fold(d.text)) + " ") for d in docs if d.text]
    out = set()
    for i in items:
        for m in i.messages or []:
            if m.role == "system" or not m.content:
                continue
            w = fold(m.content)
            k = min(12, len(w))
            grams = {" " + " ".join(w[j : j + k]) + " " for j in range(len(w) - k + 1)} if w else set()
            for doc, t in texts:
                if any(g in t for g in grams):
                    out.add((i.item_id, doc))
    return out


def test_pairs_equal_brute_force(spark):
    items, docs = _items(spark, SF2), table(spark, SF2, "documents")
    got = {(r.item_id, r.doc_id) for r in leakage.leaks(items, docs).collect()}
    assert got == brute(items.collect(), docs.collect()) and len(got) > 20
    # short tiles find more pairs, and the same long ones
    more = leakage.leaks(items, docs, tile_words=5, coverage=0.6).collect()
    assert {(r.item_id, r.doc_id) for r in leakage.leaks(items, docs, tile_words=5).collect()} == got <= {(r.item_id, r.doc_id) for r in more}


def test_tiles_are_greedy_and_do_not_overlap():
    import numpy as np

    # passage words 0..19; text has 10..19 then 0..9: two tiles
    pos = np.array([*range(0, 8), *range(10, 18)])
    at = np.array([*range(10, 18), *range(0, 8)])
    assert sorted(leakage.tiles(pos, at, 3)) == [(0, 10, 10), (10, 0, 10)]
    # a passage word run twice in the text is tiled once
    pos, at = np.array([0, 1, 10]), np.array([0, 1, 0])
    assert leakage.tiles(pos, at, 3) == [(0, 0, 4)]


def test_edge_cases(spark):
    m = "item_id long, messages array<struct<role:string,content:string>>, doc_id long"
    long = " ".join(f"w{i}" for i in range(14))
    items = spark.createDataFrame([(1, [("user", long)], 1), (2, None, 1), (3, [("system", "a b c")], 1), (4, [("user", "Tidal-\nwave Café!")], 1), (5, [(None, "...")], 1), (None, [("user", "x")], 1)], m)
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "so " + " ".join(f"W{i}," for i in range(12)), 0), (4, " ".join(f"w{i}" for i in range(11)), 0), (5, "a b c tidalwave café z", 0), (5, "a b c tidalwave cafe", 0), (6, long + " pad" * 200000, 0)], "doc_id long, text string, item_id int")
    got = {(r.item_id, r.doc_id) for r in leakage.leaks(items, docs).collect()}
    assert got == {(1, 3), (1, 6), (4, 5)}
    assert leakage.leaks(items.limit(0), docs).count() == 0
    assert leakage.leaks(items, docs.limit(0)).count() == 0


def test_coverage_finds_reordered_passages(spark):
    import random

    rng = random.Random(3)
    parts = [[f"q{i}w{j}" for j in range(7)] for i in range(5)]
    passage = " ".join(w for p in parts for w in p)
    items = spark.createDataFrame([(1, [("user", passage)])], "item_id long, messages array<struct<role:string,content:string>>")
    rows = []
    for i in range(6):
        order = parts[:]
        while any(a + 1 == b for a, b in zip(map(parts.index, order), map(parts.index, order[1:]))):
            rng.shuffle(order)
        kept = order[: 5 if i < 4 else 2]  # two fifths are not enough
        rows.append((i, "well " + " then ".join(" ".join(p) for p in kept) + " so " * 40))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert leakage.leaks(items, docs).count() == 0
    got = {r.doc_id: r for r in leakage.leaks(items, docs, tile_words=5, coverage=0.6).collect()}
    assert set(got) == {0, 1, 2, 3} and all(r.n_tiles == 5 and r.longest == 7 and r.coverage == 1.0 for r in got.values())
