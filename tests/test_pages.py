import pytest
from corpusmill.functions import text as T
from corpusmill.functions import tokens
from corpusmill.operators import pages
from corpusmill.sources import readers
from pyspark.sql import functions as F

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
HTML = """<html><head><title>Sports 2025 - 26</title></head><body><main><h1>Teams</h1><p>Our teams.</p></main>
<script type="application/json">{"teams": [{"team": "Rowing", "season": "spring", "head_coach": "A", "games": [{"opponent": "North", "date": "d1", "result": "W"}, {"opponent": " "}], "records": [{"type": "wins", "value": "3"}, {"type": "x"}]}, {"season": "none"}],
"courses": [{"courseTitle": "Clay", "description": "Pots.", "courseCode": "ART 101"}, {"title": "No text", "code": "X 1"}], "people": [{"name": "Ann Lee", "role": "Dean"}, {"name": "Bo"}]}</script></body></html>"""


def test_rows_of_a_page(spark):
    got = pages.document_rows(spark.createDataFrame([("https://h/x", "athletics", HTML)], "url string, page_type string, html string"), "s1")
    r = got.first()
    assert (r.title, r.text, r.school_year, r.source_family) == ("Sports 2025 - 26", "Teams\nOur teams.", "2025-26", "athletics") and r.id.startswith("document-") and len(r.id) == 33
    chunks = pages.chunk_rows(got).collect()
    assert [(c.chunk_index, c.text) for c in chunks] == [(0, "Sports 2025 - 26\nTeams\nOur teams.")]
    objects = readers.script_objects(spark.createDataFrame([(1, HTML)], "i int, page string"), "page").select("i", "object")
    teams = pages.teams(objects)
    assert [(t.team_name, t.place) for t in teams.collect()] == [("Rowing", 0)]
    assert [(g.opponent, g.game_date, g.result, g.season) for g in pages.games(teams).collect()] == [("North", "d1", "W", "spring")]
    assert [(x.record_type, x.value) for x in pages.records(teams).collect()] == [("wins", "3")]
    assert [(c.course_key, c.title) for c in pages.course_rows(objects).collect()] == [("art-101", "Clay")]
    assert [(p.faculty_key, p.role_title) for p in pages.faculty_rows(objects).collect()] == [("ann-lee", "Dean")]


def test_handbook_and_seeds(spark):
    marked = readers.marked_pages(spark.createDataFrame([("=== Page 1 ===\nDress Code\nBe neat and tidy at all times.\n=== Page 2 ===\n12 34 56 78 90 12 34 56 78 90 12",)], "text string")).select("page", "page_text")
    rows = pages.handbook_sections(marked, "v1").orderBy("page").collect()
    assert [(r.section_title, r.section_key, r.citation_label) for r in rows][0] == ("Dress Code", "v1-dress-code-1", "v1, page 1") and {r.extraction_quality for r in rows} == {"degraded"}
    seeds = spark.createDataFrame([("u", "a", None, None, 0, 1), (" u ", "a", None, None, 1, 2), ("", "a", None, None, 2, 3), ("v", None, "2025", None, 3, 4)], "url string, page_type string, school_year string, department string, ord int, payload int")
    assert sorted((r.url, r.ord, r.payload) for r in pages.merged_seeds(seeds).collect()) == [("u", 0, 2), ("v", 3, 4)]
    t = spark.createDataFrame([("2025-01-01", "athletics"), ("2025-01-01", "faculty"), ("2025-01-01", "other")], "d string, f string").select(pages.stale(F.col("d").cast("timestamp"), F.col("f"), F.lit("2025-01-01 12:00:00").cast("timestamp")).alias("s"))
    assert [r.s for r in t.collect()] == [True, False, False]


SPECIALS = {"<|user|>": 32001, "<|assistant|>": 32002, "</s>": 2, "<|user|>x": 32009}


def test_special_tokens_and_labels(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    rows = spark.createDataFrame([(0, "<|user|>\nhi there</s>"), (1, "<|user|>xyz"), (2, ""), (3, None)], "i int, t string")
    got = {r.i: r.x for r in rows.select("i", tokens.encode(F.col("t"), PIECES, SPECIALS, True, True).alias("x")).collect()}
    assert got[0] == [1, 32001, *sp.encode("\nhi there"), 2, 2] and got[1] == [1, 32009, *sp.encode("yz"), 2] and got[2] == [1, 2] and got[3] is None
    back = rows.where("i = 0").select(tokens.decode(tokens.encode(F.col("t"), PIECES, SPECIALS), PIECES).alias("t")).first().t
    assert "hi there" in back
    assert tokens.answer_labels([5, 9, 7, 1, 2, 9, 7, 3], 9, 2, 2) == [-100, -100, -100, 1, 2, -100, -100, 3]
    chat = T.render_chat(F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("yes it is").alias("content"))))
    e = spark.range(1).select(tokens.encode_chat(chat, PIECES, SPECIALS, 40, 0).alias("e")).first().e
    assert len(e.input_ids) == len(e.labels) == 40 and e.labels.count(-100) < 40
    assert [a for a, b in zip(e.input_ids, e.labels) if b != -100] == [b for b in e.labels if b != -100] and [b for b in e.labels if b != -100][-1] == 2
