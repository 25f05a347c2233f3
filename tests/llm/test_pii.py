import random
import time

import numpy as np
import pytest
from conftest import SF2
from corpusmill.core.tables import table
from corpusmill.llm import pii

KNOWN = {"ada": (9, 5), "brennholt": (7, 4), "marwick": (6, 4), "contact": (60, 0), "library": (80, 0), "north": (40, 0), "die": (60, 0), "familie": (50, 0), "tobias": (8, 5)}


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(table(spark, SF2, "documents"))[0]


def found(tagger, text, known=KNOWN):
    return {(pii.LABELS[k], text[a:e]) for _, a, e, k in tagger.find([text], tagger.lexicon.with_counts(known))}


def test_forms(tagger):
    t = (
        "Dr. Ada K. Brennholt met Marwick, Tobias near Marwick Library. Tobias laughed. Mail <ada.b+x@post.example.org>, or t.m [at] mail [dot] example [dot] net.\n"
        "Call (212) 555-0134 ext. 32. SSN 987-65-4321, passport no. X12345678. Invoice 2019/50519, order 25-13-311, version 3.24.12.499, ISBN 978-0-00-26525-3.\n"
        "She lives at 12 Copper Kettle Close, Apt 4B, Fennport 00417. Tél. : 01 99 00 09 84. Die Familie wohnt Lindenhofweg 61a. C. Brennholt."
    )
    assert found(tagger, t) == {
        ("name", "Ada K. Brennholt"), ("name", "Marwick, Tobias"), ("name", "C. Brennholt"), ("email", "ada.b+x@post.example.org"), ("email", "t.m [at] mail [dot] example [dot] net"),
        ("phone", "(212) 555-0134 ext. 32"), ("phone", "01 99 00 09 84"), ("idnum", "987-65-4321"), ("idnum", "X12345678"), ("address", "12 Copper Kettle Close, Apt 4B"), ("address", "Lindenhofweg 61a"),
    }


ODD = [
    "ada.b@post.example, x@y.example@z.example (at) b_c [ AT ] d.example; é@ä.example e&#64;f.example g%40h.example i＠j.example k @ l.example @m.example ..n@o.example",
    "ada at post dot example and at at dot dot dot example, b at c. com; p {at} q dot example",
    "(+1) (212) AB-555-0134-A, extension 5, 1 (212) 555 0134 12 3456 78901 2 345, A-1234567B AB-1234567 x1234567 1234567@ +44 (0)20 7946 0958x12/ 2019-01-02 1234567890123456789",
    "1" + " " * 16 + "23456 7" + " " * 17 + "8901234, １２３４５６７, 12 ²34567",
]


def test_candidates_are_those_of_the_plain_patterns():
    rng = random.Random(4)
    signs = ["@", " at ", " dot ", "(at)", "[ AT ]", "{at} ", "&#64;", "%40", "＠", "ada", "b.c", "é", ".", "_", "-", "+", "\xa0", "\n", ", ", "(", ")", " ", "12", "555", "0134", "7946 ", "AB-", "A", " ext. ", "extension ", "/", "１"]
    for t in ODD + ["".join(rng.choices(signs, k=rng.randint(3, 30))) for _ in range(4000)]:
        if any(h in t for h in pii._EMAIL_HINTS):
            assert pii.emails(t) == [m.span() for m in pii.EMAIL.finditer(t)], t
        spans = [m.span() for m in pii.NUMBER.finditer(t) if 7 <= sum(c.isdigit() for c in m.group()) <= 18 and not pii._DATE.fullmatch(m.group())]
        assert pii.numbers(t, []) == spans, t
        word = [pii._LAST_WORD.search(t, max(0, a - 24), a) for a in range(len(t) + 1)]
        assert [pii._word_before(t, a) for a in range(len(t) + 1)] == [pii.folded(m.group(1)) if m else "" for m in word], t


def test_candidates_cost_less_than_the_plain_patterns():
    """The patterns try every character; candidates may stand only at few of them."""
    t = "The keeper of the lanterns wrote 12 letters in 2019, as the ledger of the harbour says. " * 2000 + "Call (212) 555-0134 or mail ada.b@post.example, please."

    def least(f):
        out = []
        for _ in range(3):
            start = time.process_time()
            f()
            out.append(time.process_time() - start)
        return min(out)

    assert least(lambda: pii.emails(t)) < 0.5 * least(lambda: list(pii.EMAIL.finditer(t))) and len(pii.emails(t)) == 1
    assert least(lambda: pii.numbers(t, [])) < 0.8 * least(lambda: list(pii.NUMBER.finditer(t))) and len(pii.numbers(t, [])) == 1


def _planted(n, rng):
    """Held-out documents: an unheard-of name after a title, and bare mentions of it elsewhere. [(text, spans of bare mentions)]"""
    word = lambda: "".join(rng.choice("bdfgklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(2, 3))).capitalize() + rng.choice(["", "n", "k", "s"])
    fill = ["The kiln was mended in the long break.", "Nobody knew which ledger was meant.", "It rained on the boats all day.", "In the end the lantern was found again."]
    out = []
    for _ in range(n):
        given, family = word(), word()
        clear = rng.choice([f"Thanks to Dr. {given} {family} for the help.", f"Late work was handed in by Mrs. {given} {family}, it seems."])
        bare = rng.choice([f"{given} {family}", f"{family}, {given}", f"{given} {family}"])
        text = " ".join([rng.choice(fill), clear, rng.choice(fill), "After that, as we heard,"]) + " "
        out.append((text + f"{bare} spoke. " + rng.choice(fill), (len(text), len(text) + len(bare))))
    return out


def test_message_passing_changes_labels_and_raises_recall(tagger):
    docs = _planted(300, random.Random(11))
    texts = [t for t, _ in docs]
    recall = {}
    for passing in (True, False):
        spans = {(d, a, e) for d, a, e, k in tagger.find(texts, passing=passing) if pii.LABELS[k] == "name"}
        recall[passing] = sum((d, *span) in spans for d, (_, span) in enumerate(docs)) / len(docs)
    assert recall[True] > recall[False] + 0.03


def test_skip_edges_settle_a_number(tagger):
    text = "Social Security no. 912345678 was given. Later on the note said 912345678 once more."
    got = tagger.find([text])
    assert [(pii.LABELS[k], text[a:e]) for _, a, e, k in got] == [("idnum", "912345678")] * 2


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(3)
    k = len(pii.LABELS)
    scores, field = rng.normal(size=(4, k)), pii.Field()
    field.pair = rng.normal(size=field.pair.shape)
    kind = np.array([1, 4, 5])
    got = field.marginals(scores, np.stack([np.arange(3), np.arange(1, 4), kind], axis=1), rounds=60)
    total = np.zeros((k,) * 4)
    for x in np.ndindex(total.shape):
        total[x] = sum(scores[i, x[i]] for i in range(4)) + sum(field.pair[kind[i], x[i], x[i + 1]] for i in range(3))
    p = np.exp(total - total.max())
    for i in range(4):
        m = p.sum(axis=tuple(j for j in range(4) if j != i))
        assert np.allclose(np.exp(got[i]), m / m.sum(), atol=1e-6)


def test_fitted_weights_hold_on_documents_left_out(spark):
    """Fitted on the documents of even id, against the clear labels from afar of the others."""
    docs = table(spark, SF2, "documents")
    tagger, _ = pii.train(docs.where("doc_id % 2 = 0"))
    right = clear = 0
    for r in docs.where("doc_id % 2 = 1 and length(text) > 2").select("text").collect():
        tokens, runs = pii.tokens_of(r.text, tagger.lexicon)
        if not tokens:
            continue
        pii.guesses(r.text, tokens, runs)
        graph = pii.Graph()
        graph.add(r.text, tokens)
        index, starts, mask, edges = graph.arrays()
        label = tagger.field.marginals(tagger.field.scores(index, starts, mask), edges).argmax(1)
        clear += sum(t.clear for t in tokens)
        right += sum(t.clear and t.guess == k for t, k in zip(tokens, label))
    assert clear > 500 and right / clear > 0.97


def test_the_joined_way_gives_the_same_items(spark):
    docs, sources = table(spark, SF2, "documents"), table(spark, SF2, "data_sources")
    one, two = (sorted(map(tuple, pii.items(docs, sources, **k).collect())) for k in ({}, {"bound": 10}))
    assert one == two and len(one) > 500


def test_scrub_keeps_the_rest_and_follows_the_sources(spark):
    docs, sources = table(spark, SF2, "documents"), table(spark, SF2, "data_sources")
    before = {r.doc_id: r for r in docs.collect()}
    after = {r.doc_id: r.text for r in pii.scrub(docs, sources).collect()}
    off = {r.name for r in sources.collect() if r.pii_scrub is False}
    items = {}
    for r in pii.items(docs, sources).collect():
        items.setdefault(r.doc_id, []).append(r)
        assert r.found_text in before[r.doc_id].text and before[r.doc_id].source not in off
    assert set(before) == set(after) and len(items) > 200
    for i, r in before.items():
        if i not in items:
            assert after[i] == r.text
        else:
            assert after[i] != r.text and all(x.found_text not in after[i] for x in items[i] if x.kind == "email")


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "x@y.example " * 2 + "pad " * 100000, "b"), (3, "x@y.example", "b"), (4, "x@y.example", "off")], "doc_id long, text string, source string")
    sources = spark.createDataFrame([("off", False), ("off", None), (None, False), ("a", None)], "name string, pii_scrub boolean")
    got = sorted(tuple(r) for r in pii.items(docs, sources).collect())
    assert [r for r in got if r[1] == "email"] in ([(3, "email", "x@y.example")], [(3, "email", "x@y.example")] * 2)
    assert pii.items(docs.limit(0), sources).count() == 0 and pii.scrub(docs, sources.limit(0)).count() == 5
