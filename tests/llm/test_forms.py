import numpy as np
import pyarrow as pa
from conftest import SF2
from corpusmill.core.tables import table
from corpusmill.llm import forms


def test_held_out_labels(spark):
    """Fitted on half of the labelled documents of sf0.1, right on the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "form_labels")
    rows = {r.doc_id: r.label for r in forms.labelled(labels, 4000).collect()}
    half = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in forms.text_quality(docs, half).where("doc_id % 2 = 1").collect()}
    pairs = [(rows[i], got[i].prose_share >= 0.5) for i in rows if i % 2 and got[i].prose_share is not None]
    right = sum((form == "prose") == prose for form, prose in pairs)
    assert len(pairs) > 300 and right / len(pairs) > 0.95  # about one label in thirty errs


def test_statistics_of_lines():
    x = forms.Lines([b"the cat sat. the cat sat.", b"- one", b""], np.array([0, 0, 1]))
    assert x.words.tolist() == [6, 1, 0] and x.common.tolist()[0] == 2 and x.repeats.tolist() == [1, 0, 0] and x.triples.tolist() == [5, 0, 0]
    assert x.last.tolist()[:2] == [1, 0] and x.letters.tolist() == [18, 3, 0]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, "a"), (2, " \n ", "https://h/x", "a"), (3, "?", None, "a"), (3, "?", None, "a"), (4, "word " * 300000, "https://h/y", "a")], "doc_id long, text string, url string, form string")
    labels = table(spark, SF2, "form_labels")
    got = sorted(forms.text_quality(docs, labels).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [1, 2, 3, 3, 4] and got[0].prose_share is None and got[1].n_words == 0 and got[4].n_words == 300000
    assert forms.not_prose(forms.text_quality(docs, labels.limit(0))).count() >= 0
    assert forms.text_quality(docs.limit(0), labels).count() == 0


def test_many_repeats_take_the_joined_way(spark):
    docs, labels = table(spark, SF2, "documents"), table(spark, SF2, "form_labels")
    one = {r.doc_id for r in forms.not_prose(forms.text_quality(docs, labels)).collect()}
    two = {r.doc_id for r in forms.not_prose(forms.text_quality(docs, labels, block=200)).collect()}
    assert one and len(one ^ two) <= 0.02 * len(one)


def test_labelled_texts_are_worked_off_together(monkeypatch):
    texts = ["the cat sat.\n\n- one\n- two\nthe cat sat. the cat sat.", None, "a;b;c\n1;2;3\n", " \n", "One sentence. " * 40, "é" * 5 + "\nand so on"] * 20
    rows = {"doc_id": range(len(texts)), "text": texts, "mark": [[2], None, [1], None, None, []] * 20, "label": ["prose"] * len(texts)}
    batch, run = pa.RecordBatch.from_pydict(rows), forms._line_statistics(None)
    bodies, body = [], forms._body
    monkeypatch.setattr(forms, "_body", lambda *a: bodies.append(len(a[0])) or body(*a))
    together = pa.Table.from_batches(run(iter([batch])))
    assert bodies == [len(texts)]  # a text by itself costs ten times as much
    assert together.to_pylist() == [r for k in range(len(texts)) for part in run(iter([batch.slice(k, 1)])) for r in part.to_pylist()]


def test_paths_equal_a_loop():
    rng = np.random.default_rng(3)
    k = len(forms._LABEL)
    model = forms.Model()
    model.first, model.move, model.emit = rng.normal(size=k), rng.normal(size=(k, k)), [rng.normal(size=(n, k)) for n in forms._SIZES]
    doc = np.repeat([0, 2, 3, 7, 8], [1, 40, 3, 1, 17])
    x = forms.Lines.of(np.stack([rng.integers(0, n, len(doc)) for n in forms._SIZES], axis=1), doc, np.ones(len(doc), np.int64))
    lean = rng.normal(size=(len(doc), k))
    e = model.scores(x) + lean
    want = []
    for a, b in zip(x.starts, [*x.starts[1:], len(doc)]):
        best, back = e[a] + model.first, []
        for row in e[a + 1 : b]:
            via = best[:, None] + model.move
            back.append(via.argmax(0))
            best = via.max(0) + row
        path = [best.argmax()]
        for came in reversed(back):
            path.append(came[path[-1]])
        want += path[::-1]
    assert model.path(x, lean).tolist() == want
    assert forms.Model().path(forms.Lines([], np.zeros(0, np.int64))).tolist() == []
