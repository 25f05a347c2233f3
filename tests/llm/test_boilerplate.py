import random
import unicodedata

import numpy as np
from conftest import SF2
from corpusmill.core.tables import table
from corpusmill.llm import boilerplate

VERBS = ["mend", "paint", "count", "carry", "weigh", "draw", "file", "trade"]
NOUNS = ["kiln", "canoe", "ledger", "lantern", "anchor", "violin", "compass", "teapot", "saddle", "easel"]


def corpus(n_pages=300, n_plain=600):
    rng = random.Random(5)
    prose = lambda: "On day " + str(rng.randint(1, 99)) + " " + " and ".join(f"they {rng.choice(VERBS)} the {rng.choice(NOUNS)} near {rng.choice(NOUNS)}s" for _ in range(4)) + "."
    rows, truth = [], set()
    for i in range(n_pages):
        host = f"h{i % 3}.example"
        lines = [(True, "Home | Staff | Visit us"), (True, f"Home > Visit us > {rng.choice(NOUNS).title()}"), (False, prose()), (False, ""), (False, "- " + rng.choice(NOUNS)), (False, prose()), (True, f"Last updated 3/{rng.randint(1, 28)}/2024"), (True, f"{90 + i % 3} Elm Row"), (True, f"(c) {rng.randint(2000, 2024)} School number {i % 3}")]
        rows.append((i, f"https://{host}/{i}", "\n".join(x for _, x in lines)))
        truth |= {("documents", i, k) for k, (frame, x) in enumerate(lines, 1) if frame}
    for i in range(n_plain):
        rows.append((10_000 + i, None, "\n".join([prose(), "- " + rng.choice(NOUNS), prose(), f"{rng.randint(1, 80)} Elm Row"])))
    return rows, truth


def score(got, truth):
    return len(got & truth) / max(1, len(got)), len(got & truth) / len(truth)


def test_frames_of_an_invented_site(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, url string, text string")
    cites = spark.createDataFrame([(1, None), (2, " "), (3, "Home | Staff | Visit us\nthey mend the kiln near easels\nLast upda"), (3, None)], "citation_id long, snippet string")
    got = {tuple(r) for r in boilerplate.frames(docs, cites).collect()}
    precision, recall = score({x for x in got if x[0] == "documents"}, truth)
    assert precision > 0.99 and recall > 0.95
    assert ("citations", 3, 1) in got and ("citations", 3, 2) not in got


def _texts(docs):
    from pyspark.sql import functions as F

    return docs.select(F.lit("documents").alias("record_table"), F.col("doc_id").alias("record_id"), boilerplate.host(F.col("url")).isNotNull().alias("web"), "text")


def test_the_joined_way_gives_the_same_lines(spark):
    docs, cites = table(spark, SF2, "documents"), table(spark, SF2, "citations")
    repeats = boilerplate.frame_repeats(docs)
    a, b = ({tuple(r) for r in boilerplate.frame_lines(_texts(docs), repeats, **k).collect()} for k in ({}, {"bound": 300}))
    assert len(a) > 1000 and a == b
    assert boilerplate.frames(docs.limit(0), cites.limit(0)).count() == 0


def test_parts_and_partitions_change_nothing(spark):
    docs = table(spark, SF2, "documents")
    want = _repeats(docs.coalesce(1))
    assert _repeats(docs.repartition(16), pages_per_part=3) == want and len(want) > 1000


def test_a_long_notice_and_what_stands_in_it(spark):
    """A notice of 74 words on every page; seven words in its middle are common in prose as well."""
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(k))
    before, after = " ".join(word(3) for _ in range(33)), " ".join(word(3) for _ in range(34))
    notice = f"{before} mend the kiln near the old ledger {after}"
    rows = [(i, f"https://h{i % 2}.example/{i}", f"{' '.join(word(2) for _ in range(40))} mend the kiln near the old ledger\n{notice}\nshort {word(4)}") for i in range(12)]
    rows += [(100 + i, None, f"{word(4)} they mend the kiln near the old ledger {' '.join(word(2) for _ in range(90))}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, url string, text string")
    repeats = boilerplate.frame_repeats(docs)
    assert repeats.where("plain is null").count() > 0  # longer repeats
    assert {tuple(r) for r in boilerplate.frame_lines(_texts(docs), repeats).collect()} == {("documents", i, 2) for i in range(12)}
    # words that alone are prose are covered by the longer repeats around them
    s = boilerplate.Stream([boilerplate.fold(rows[0][2])])
    hashes = lambda df: boilerplate.Frames(np.array([r.h for r in df.collect()], np.int64).tobytes())
    assert hashes(repeats).covered(s)[1] == 74 and hashes(repeats.where("plain is not null")).covered(s)[1] < 74


def test_reported_lines_are_not_blank(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF2, "documents").collect()}
    rows = boilerplate.frames(table(spark, SF2, "documents"), table(spark, SF2, "citations")).where("record_table = 'documents'").collect()
    assert rows and all(docs[r.record_id].split("\n")[r.line_no - 1].strip() for r in rows)


def _repeats(docs, **k):
    return {tuple(r) for r in boilerplate.frame_repeats(docs, **k).collect()}


def test_repeats_do_not_depend_on_parts_and_partitions(spark):
    menu, prose = "Home | Staff | Visit us", "they mend the old kiln"
    rows = [(i, f"https://h.example/{i}", f"{menu}\n{prose}\nday {i} of many\n" + ("Fair in the park {i}\nring 555 0100 now" if i % 4 == 0 else "")) for i in range(24)]
    rows += [(100 + i, None, f"{prose}\nnote {i} on canoes {'x' * i}") for i in range(24)]
    rows += [(200 + i, "https://h.example/copy", "Copied page of all\nsame as ever") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, url string, text string")
    # the same counts by hand: distinct pages of the host, distinct texts without a url
    want = _repeats(docs.coalesce(1))
    tokens = lambda line: boilerplate.Stream([line]).token[1:1 + boilerplate.DEPTH]
    h = lambda line: int(boilerplate._hash(tokens(line), np.array([0]), boilerplate.DEPTH, 1).view(np.int64)[0])
    by_hash = {r[0]: r[1:] for r in want}
    assert by_hash[h(b"home | staff")] == (24, 0) and by_hash[h(b"fair in the")] == (6, 0)
    assert h(b"they mend the") not in by_hash and h(b"copied page of") not in by_hash
    assert _repeats(docs.repartition(48)) == want
    assert _repeats(docs.repartition(7), pages_per_part=1) == want
    assert _repeats(docs, pages_per_part=5) == want


def test_a_path_in_the_joined_way(spark):
    path = b"home > visit us > the old and very long title of this page"
    s = boilerplate.Stream([path])
    at, _ = s.windows()
    known = [boilerplate._hash(token, at[of], depth, salt)[at[of] < 5] for token, of, depth, salt in boilerplate._families(s, at)]
    repeats = spark.createDataFrame([(int(h),) for h in np.concatenate(known).view(np.int64)], "h long")
    texts = spark.createDataFrame([("t", 3, True, path.decode()), ("t", 1, True, path.decode()), ("t", 1, True, "home > visit us\nno frame words"), ("t", 2, True, "nothing of the kind")], "record_table string, record_id long, web boolean, text string")
    one, many = (sorted(map(tuple, boilerplate.frame_lines(texts, repeats, bound=k).collect())) for k in (1000, 1))
    assert ("t", 3, 1) in many and one == many


def test_folding_by_characters():
    rng = random.Random(2)
    odd = "éÅÃ©ﬁ½İKΣς\u0301\u0345\u00ad\x01\x7f\x85\u2028\ud800한中😀ǅ"
    texts = ["".join(rng.choice(odd + "aZ 1.\n\t") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["".join(map(chr, range(0x20, 0x600))), "".join(map(chr, range(0x4E00, 0x4F00)))]
    for t in texts:
        try:
            mended = t.encode("latin-1").decode("utf-8") if set(t) & set("ÃÂâ") else t
        except UnicodeError:
            mended = t
        whole = mended if t.isascii() else boilerplate.DROPPED.sub("", unicodedata.normalize("NFKD", mended))
        assert boilerplate.fold(t) == whole.lower().encode("ascii", "replace"), t


def test_order_of_hashes():
    rng = np.random.default_rng(1)
    few = rng.integers(0, 50, 1000).astype(np.uint64)  # differ in the low bits only
    for h in (few, few << np.uint64(50), rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2), few[:1], few[:0]):
        assert (boilerplate.order(h) == np.argsort(h, kind="stable")).all()
