import pytest
from conftest import SF2
from corpusmill.core.tables import table
from corpusmill.llm import encoding

tokenizers = pytest.importorskip("tokenizers")


def reference():
    t = tokenizers.Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


ODD = [
    None, "", " ", "  ", "\n", " \n x", "a  b", "a \n\n  b ", "it's we'll I've 'don't' 's 'sun ''s x's' '", " 's", "x 'll", "12 34a5", "été naïve x", "é ​ ﻿ok",
    "谢谢 \U0001f642 \U0001f3f4‍☠️", "<|endoftext|>", "\x00\x01\x85 y", "tab\tx\r\n y", "'", "'re", "'r", "'v", "a'l", "x" * 5000, " ... !!! ?", "١٢ ½ ²", "end ",
]


def test_corpus_equals_the_library(spark):
    docs = table(spark, SF2, "documents").select("doc_id", "text").collect()
    t = reference()
    expected = {d.doc_id: t.encode(d.text or "", add_special_tokens=False).ids for d in docs}
    got = {r.doc_id: list(r.ids) for r in encoding.encode(table(spark, SF2, "documents")).collect()}
    assert got == expected
    n = {r.doc_id: r.n_tokens for r in encoding.token_counts(table(spark, SF2, "documents")).collect()}
    assert n == {k: len(v) for k, v in expected.items()}


def test_odd_texts_and_round_trip(spark):
    t = reference()
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    encoded = encoding.encode(docs)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(ODD)}
    back = {r.doc_id: r.text for r in encoding.decode(encoded).collect()}
    assert back == {i: x or "" for i, x in enumerate(ODD)}
    assert {r.doc_id: r.text for r in encoding.decode(spark.createDataFrame([(1, None), (2, []), (3, [15496])], "doc_id long, ids array<int>")).collect()} == {1: None, 2: "", 3: "Hello"}
    with pytest.raises(Exception, match="not in the vocabulary"):
        encoding.decode(spark.createDataFrame([(1, [15496, 99_999_999])], "doc_id long, ids array<int>")).collect()


def test_frequent_words_take_the_other_join(spark):
    chunks = spark.createDataFrame([(i, ["the", f"w{i}", "of"][: 1 + i % 3]) for i in range(20)], "chunk long, words array<string>")
    words = spark.createDataFrame([(w, [len(w)]) for w in ["the", "of", *(f"w{i}" for i in range(20))]], "word string, ids array<int>")
    one, two, three = ({r.chunk: sorted(map(tuple, r.found), key=str) for r in encoding._placed(chunks, "words", words, "word", **k).collect()} for k in ({}, {"often": 3}, {"often": 3, "most": 1}))
    assert one == two == three and len(one) == 20


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "z"), (1, "a b", "z"), (None, "c", "z")], "doc_id long, text string, ids string")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in encoding.encode(docs).collect()) == [(0, 1), (1, 2), (1, 2)]
    assert encoding.encode(docs.limit(0)).count() == 0
