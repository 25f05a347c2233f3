"""Further core queries: shapes, predicates, page rows, audits, folds. Imported by the registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.core.tables import table
from corpusmill.functions import text as T
from corpusmill.functions import tokens
from corpusmill.operators import corpus, evals, examples, pages, retrieval, snapshots
from corpusmill.registry import _clean, _ends, _norm, _numbered, _page, _sq, _words, query

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPECIALS = {"<|system|>": 32000, "<|user|>": 32001, "<|assistant|>": 32002, "<|tool|>": 32003, "</s>": 2}


# sources and sinks ----------------------------------------------------------------------------------


@query("SELECT doc_id, source, lang FROM documents WHERE text IS NOT NULL AND source IN ('site_news', 'newsletter') AND lang = 'en'")
def f10_family_filter(spark, d):
    return table(spark, d, "documents").where("text is not null and source in ('site_news', 'newsletter') and lang = 'en'").select("doc_id", "source", "lang")


@query("SELECT doc_id, source || '|' || coalesce(lang, '') || '|' || coalesce(school_year, '') AS meta FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def f02_metadata_projection(spark, d):
    m = F.create_map(*(x for c in ("source", "lang", "school_year") for x in (F.lit(c), F.coalesce(c, F.lit("")))))
    rows = table(spark, d, "documents").where("text is not null and source is not null").select("doc_id", m.alias("m"))
    return rows.select("doc_id", F.concat_ws("|", *(F.col("m")[c] for c in ("source", "lang", "school_year"))).alias("meta"))


@query("SELECT count(*) AS n, count(DISTINCT code) AS codes FROM courses WHERE lower(trim(snapshot_id)) = 'snap-finch'")
def s23_snapshot_scan(spark, d):
    return table(spark, d, "courses").where("lower(trim(snapshot_id)) = 'snap-finch'").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("codes"))


@query("SELECT CAST(floor(ord / 32) AS BIGINT) AS batch, count(*) AS n FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents) GROUP BY 1 HAVING count(*) = 32")
def s24_batches_drop_last(spark, d):
    rows = corpus.shards(_numbered(table(spark, d, "documents").select("doc_id"), "doc_id"), "ord", 32)
    return rows.groupBy(F.col("shard").alias("batch")).agg(F.count(F.lit(1)).alias("n")).where("n = 32")


@query("SELECT item_id, len(messages) AS n, messages[-1].role AS last_role FROM posttrain_regression")
def s22_regression_prompts(spark, d):
    m = examples.sft_messages(F.col("messages"))
    rows = table(spark, d, "posttrain_regression")
    return rows.select("item_id", F.size("messages").cast("long").alias("n"), F.try_element_at(m, F.lit(-1))["role"].alias("last_role"))


@query(f"SELECT t AS line FROM (SELECT doc_id, t, length(t) + 1 AS n, sum(length(t) + 1) OVER (ORDER BY doc_id) AS upto, row_number() OVER (ORDER BY doc_id) AS k FROM (SELECT doc_id, {_clean('text')} AS t FROM documents WHERE text IS NOT NULL) WHERE length(t) >= 128) WHERE upto - n < 150000 AND k <= 400")
def k07_tokenizer_corpus(spark, d):
    """Lines of a tokenizer corpus: normalised texts of a least length, to a document and a character budget."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", T.normalize_whitespace(F.col("text")).alias("line")).where(F.length("line") >= 128)
    rows = rows.withColumn("n", (F.length("line") + 1).cast("long")).withColumn("one", F.lit(1).cast("long"))
    return corpus.budget_prefix(rows, {"n": 150_000, "one": 400}, "doc_id").select("line")


@query("SELECT example_id, CAST(length(chosen) AS INT) AS chosen_n, CAST(length(rejected) AS INT) AS rejected_n, CAST(length(chosen) - length(rejected) AS INT) AS margin FROM preference_examples WHERE len(prompt) > 0 AND chosen IS NOT NULL AND rejected IS NOT NULL")
def k02_paired_arrays(spark, d):
    rows = table(spark, d, "preference_examples").where(examples.is_preference(F.col("prompt"), F.col("chosen"), F.col("rejected")))
    return rows.select("example_id", F.length("chosen").alias("chosen_n"), F.length("rejected").alias("rejected_n"), (F.length("chosen") - F.length("rejected")).alias("margin"))


# joins, sets, order ---------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45 AND l_quantity >= 45")
def j11_lookup(spark, d):
    p = table(spark, d, "part").where("p_size > 45").select("p_partkey", "p_brand")
    return table(spark, d, "lineitem").where("l_quantity >= 45").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand")


@query("SELECT item_id, list_has_any(tags, ['catalog', 'advising']) AS expected FROM posttrain_regression WHERE tags IS NOT NULL")
def j12_expected_overlap(spark, d):
    return table(spark, d, "posttrain_regression").where("tags is not null").select("item_id", F.arrays_overlap("tags", F.array(F.lit("catalog"), F.lit("advising"))).alias("expected"))


@query("SELECT result_id, source_type, source_id, min(hit_rank) AS hit_rank FROM citations GROUP BY 1, 2, 3")
def j13_citation_dedup(spark, d):
    c = table(spark, d, "citations").select("result_id", "source_type", "source_id", "hit_rank")
    return snapshots.last_wins(c, ["result_id", "source_type", "source_id"], [-F.col("hit_rank")])


@query("SELECT example_id FROM sft_examples WHERE source IN (SELECT source FROM preference_examples) GROUP BY 1")
def j14_group_semi_join(spark, d):
    return table(spark, d, "sft_examples").join(table(spark, d, "preference_examples").select("source"), "source", "left_semi").select("example_id").distinct()


@query("SELECT result_id, array_to_string(list_transform(list_distinct_ordered, lambda x: x), '|') AS titles FROM (SELECT result_id, list_filter(list_transform(hits, lambda h, i: CASE WHEN list_position(list_transform(hits, lambda g: g.title), h.title) = i THEN h.title END), lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (SELECT result_id, arg_max(hits, (created_at, len(hits))) AS hits FROM grounding_results GROUP BY 1))")
def u04_ordered_distinct(spark, d):
    g = table(spark, d, "grounding_results").withColumn("_n", F.size("hits")).groupBy("result_id").agg(F.max_by("hits", F.struct("created_at", "_n")).alias("hits"))
    return g.select("result_id", F.array_join(F.array_distinct(F.col("hits.title")), "|").alias("titles"))


@query("SELECT result_id, array_to_string(list_transform(h[1:3], lambda x: x.title), '|') AS top3 FROM (SELECT result_id, arg_max(hits, (created_at, len(hits))) AS h FROM grounding_results GROUP BY 1)")
def t08_first_three(spark, d):
    g = table(spark, d, "grounding_results").withColumn("_n", F.size("hits")).groupBy("result_id").agg(F.max_by("hits", F.struct("created_at", "_n")).alias("hits"))
    return g.select("result_id", F.array_join(F.slice(F.col("hits.title"), 1, 3), "|").alias("top3"))


@query("WITH h AS (SELECT query_key AS qid, result_id, max(route) AS route, row_number() OVER (PARTITION BY query_key ORDER BY result_id) AS rank FROM grounding_results GROUP BY 1, 2), a AS (SELECT *, max(CASE WHEN route = 'handbook' THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS pref FROM h) SELECT qid, result_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM a WHERE pref = 0 OR route = 'handbook') WHERE r <= 3")
def t03_preferred_rerank(spark, d):
    h = table(spark, d, "grounding_results").groupBy(F.col("query_key").alias("qid"), "result_id").agg(F.max("route").alias("route"))
    h = h.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("result_id")))
    return retrieval.prefer_titles(h, F.coalesce(F.col("route") == "handbook", F.lit(False)), 3).select("qid", "result_id")


@query()
def t06_term_variants(spark, d):
    q = table(spark, d, "grounding_results").where("query is not null").groupBy("result_id").agg(F.max("query").alias("query"))
    return q.select("result_id", F.posexplode(retrieval.course_code_terms(F.col("query"))).alias("priority", "term"))


@query("SELECT source, max(doc_id) AS best_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC NULLS LAST, doc_id) AS r FROM documents) WHERE r <= 1 GROUP BY 1")
def w16_keep_top(spark, d):
    return snapshots.keep_best(table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("n")), ["source"], [F.coalesce("n", F.lit(-1))], "doc_id").select("source", F.col("doc_id").alias("best_id"))


# pages ----------------------------------------------------------------------------------------------

_FAMILY = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pages.FAMILIES.items()) + " ELSE p END"


@query(f"SELECT doc_id, {_FAMILY} AS family FROM (SELECT doc_id, CASE WHEN source LIKE '%admissions' THEN 'admissions' WHEN source LIKE '%athletics' THEN 'athletics' WHEN source = 'handbook' THEN 'handbook' ELSE coalesce(source, 'generic') END AS p FROM documents)")
def j08_page_family(spark, d):
    p = F.when(F.col("source").like("%admissions"), "admissions").when(F.col("source").like("%athletics"), "athletics").when(F.col("source") == "handbook", "handbook").otherwise(F.coalesce("source", F.lit("generic")))
    return table(spark, d, "documents").select("doc_id", pages.family(p).alias("family"))


@query()
def w13_line_index(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    lines = docs.select("doc_id", F.posexplode(F.split(T.html_to_text(_page()), "\n")).alias("chunk_index", "t")).where("t <> ''")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("t")).alias("characters"))


def _documents(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), F.coalesce("source", F.lit("generic")).alias("page_type"), _page().alias("html"))
    return pages.document_rows(docs, "snap")


@query()
def page_document_rows(spark, d):
    return _documents(spark, d).select("id", "url", "title", "source_family", "school_year", "content_hash", F.length("text").alias("n"))


@query()
def page_chunk_rows(spark, d):
    return pages.chunk_rows(_documents(spark, d)).select("id", "document_id", "chunk_index", F.length("text").alias("n"))


@query()
def a15_family_metrics(spark, d):
    docs = _documents(spark, d)
    return pages.family_metrics(docs, pages.chunk_rows(docs))


@query("SELECT source, count(*) AS n, count_if(crawled_at < TIMESTAMP '2025-06-01' - INTERVAL 168 HOUR) AS stale FROM documents WHERE source IS NOT NULL AND crawled_at IS NOT NULL GROUP BY 1")
def r09_stale_pages(spark, d):
    s = pages.stale(F.col("crawled_at").cast("timestamp"), F.lit("handbook_policy"), F.lit("2025-06-01").cast("timestamp"))
    return table(spark, d, "documents").where("source is not null and crawled_at is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(s).alias("stale"))


@query("SELECT source, sum(length(regexp_replace(text, '\\PL', '', 'g'))) / (sum(length(text)) + count(*) - 1) AS alpha FROM documents WHERE text IS NOT NULL AND length(text) > 0 GROUP BY 1")
def a17_alpha_ratio(spark, d):
    rows = table(spark, d, "documents").where("text is not null and length(text) > 0")
    return rows.groupBy("source").agg((F.sum(T.letters(F.col("text"))) / (F.sum(F.length("text")) + F.count(F.lit(1)) - 1)).alias("alpha"))


# scalar functions -----------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_norm('page_title')} AS t FROM documents")
def x03_normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("page_title")).alias("t"))


@query(f"SELECT doc_id, len({_words('text')}) AS words, len(list_distinct({_words('text')})) AS distinct_words FROM documents WHERE text IS NOT NULL")
def x04_tokenize(spark, d):
    w = T.word_tokens(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words"))


_MARKERS = " OR ".join(f"contains(lower(text), '{m.replace(chr(39), chr(39) * 2)}')" for m in evals.ABSTENTIONS)


@query(f"SELECT doc_id, {_MARKERS} AS abstains, contains(lower(text), '[source:') OR contains(lower(text), '<|citation|>') AS cites FROM documents WHERE text IS NOT NULL")
def x14_markers(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", evals.abstains(F.col("text")).alias("abstains"), evals.cites(F.col("text")).alias("cites"))


@query()
def x15_repetition(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", evals.repeated_marks(F.col("text")).alias("punctuation"), evals.repeated_connectors(F.col("text")).alias("connector"))


@query()
def x21_degenerate_reasons(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(evals.degenerate_reasons(F.col("text")), ",").alias("reasons"))


@query("SELECT item_id, CASE WHEN len(expected_substrings) > 0 THEN len(list_filter(expected_substrings, lambda p: contains(lower(coalesce(reference, '')), lower(p)))) / len(expected_substrings) ELSE 0 END AS matched FROM assistant")
def x17_matched_share(spark, d):
    return table(spark, d, "assistant").select("item_id", T.matched_share(F.coalesce("reference", F.lit("")), F.col("expected_substrings")).alias("matched"))


@query("SELECT item_id, CASE WHEN coalesce(len(expected_substrings), 0) = 0 THEN trim(coalesce(reference, '')) <> '' ELSE len(list_filter(expected_substrings, lambda p: contains(lower(coalesce(reference, '')), lower(p)))) = len(expected_substrings) END AS exact FROM assistant")
def x22_grounded_score(spark, d):
    none = F.lit(None).cast("array<string>")
    return table(spark, d, "assistant").select("item_id", evals.grounded_exact(F.col("reference"), F.lit(False), [F.col("expected_substrings")], none).alias("exact"))


@query("SELECT query_key, sha256(max(query)) AS prompt_hash FROM grounding_results WHERE query IS NOT NULL GROUP BY 1")
def x47_prompt_hash(spark, d):
    return table(spark, d, "grounding_results").where("query is not null").groupBy("query_key").agg(F.sha2(F.max("query"), 256).alias("prompt_hash"))


@query("SELECT source, CAST(round_even(count(*) * 0.25, 0) AS BIGINT) AS wanted FROM documents GROUP BY 1")
def x33_half_even(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.bround(F.count(F.lit(1)) * 0.25, 0).cast("long").alias("wanted"))


@query(f"SELECT doc_id, replace(replace(regexp_extract(coalesce(page_title, '') || ' ' || text, '(20[0-9]{{2}}\\s*[-–]\\s*[0-9]{{2}})', 1), '–', '-'), ' ', '') AS school_year FROM documents WHERE regexp_matches(coalesce(page_title, '') || ' ' || text, '20[0-9]{{2}}\\s*[-–]\\s*[0-9]{{2}}')")
def x30_school_year(spark, d):
    y = T.first_school_year(F.concat_ws(" ", F.coalesce("page_title", F.lit("")), "text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", y.alias("school_year")).where("school_year is not null")


@query()
def x41_payload_hash(spark, d):
    from corpusmill.functions.hashing import canonical_sha256

    rows = table(spark, d, "courses").where("attributes is not null").select("attributes").distinct()
    return rows.select("attributes", canonical_sha256("attributes").alias("payload_hash"))


@query("SELECT example_id, coalesce(nullif(" + _sq("example_id") + ", ''), '?') AS id FROM sft_examples GROUP BY 1, 2")
def x42_example_id(spark, d):
    e = examples.example_id([F.col("example_id")], F.col("source"), F.col("messages"))
    return table(spark, d, "sft_examples").select("example_id", e.alias("id")).distinct()


@query()
def x50_json_objects(spark, d):
    """Nested objects of the JSON columns of courses, counted by their keys."""
    from corpusmill.sources.readers import script_objects

    rows = table(spark, d, "courses").where("attributes is not null").select("id", F.concat(F.lit("<script>"), "attributes", F.lit("</script>")).alias("page")).distinct()
    return script_objects(rows, "page").groupBy(F.array_join(F.array_sort(F.json_object_keys("object")), ",").alias("keys")).agg(F.count(F.lit(1)).alias("n"))


@query()
def x57_encode_chat(spark, d):
    """Chats as padded piece ids with labels on the assistant's answers."""
    rows = table(spark, d, "sft_examples").where(F.size("messages") > 0).select("example_id", T.render_chat(F.col("messages")).alias("r"))
    e = rows.select("example_id", tokens.encode_chat(F.col("r"), PIECES, SPECIALS, 256, 0).alias("e"))
    return e.select("example_id", F.size(F.filter("e.input_ids", lambda x: x != 0)).alias("tokens"), F.size(F.filter("e.labels", lambda x: x != -100)).alias("supervised"))


@query()
def x60_piece_encode(spark, d):
    rows = table(spark, d, "sft_examples").where(F.size("messages") > 0).select("example_id", T.render_chat(F.col("messages")).alias("r"))
    return rows.select("example_id", F.size(tokens.encode(F.col("r"), PIECES, SPECIALS, True, False)).alias("tokens"))


# aggregates -----------------------------------------------------------------------------------------


@query("SELECT coalesce(lower(trim(snapshot_id)), '(none)') AS domain, arg_max(route, (created_at, result_id)) AS last_route FROM (SELECT snapshot_id, created_at, result_id, coalesce(route, '') AS route FROM grounding_results) GROUP BY 1")
def a11_last_by_domain(spark, d):
    g = table(spark, d, "grounding_results").withColumn("r", F.coalesce("route", F.lit("")))
    return g.groupBy(F.coalesce(F.lower(F.trim("snapshot_id")), F.lit("(none)")).alias("domain")).agg(F.max_by("r", F.struct("created_at", "result_id")).alias("last_route"))


@query("SELECT count(*) AS queries, count_if(e) AS expected, count_if(e AND h) AS true_positives, count_if(e AND NOT h) AS false_negatives, count_if(e AND NOT h) / count_if(e) AS false_negative_rate FROM (SELECT coalesce(route, '') <> '' AS e, len(hits) > 0 AS h FROM grounding_results)")
def a10_route_audit(spark, d):
    e, h = F.coalesce("route", F.lit("")) != "", F.coalesce(F.size("hits") > 0, F.lit(False))
    return table(spark, d, "grounding_results").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(e).alias("expected"), F.count_if(e & h).alias("true_positives"), F.count_if(e & ~h).alias("false_negatives"), evals.guarded(F.count_if(e & ~h), F.count_if(e)).alias("false_negative_rate")
    )


@query("SELECT source_type, avg(CASE WHEN length(trim(coalesce(snippet, ''))) > 0 THEN 1.0 ELSE 0.0 END) AS filled_rate, count(*) AS n FROM citations GROUP BY 1")
def a06_grounded_rates(spark, d):
    filled = F.length(F.trim(F.coalesce("snippet", F.lit("")))) > 0
    return table(spark, d, "citations").groupBy("source_type").agg(evals.rate(filled).alias("filled_rate"), F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(split_group_id, source) AS grp, count(*) AS n FROM sft_examples GROUP BY 1")
def a18_group_sizes(spark, d):
    return table(spark, d, "sft_examples").groupBy(F.coalesce("split_group_id", "source").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.source, CAST(a.n AS BIGINT) AS before, CAST(b.n AS BIGINT) AS after, CAST(b.n - a.n AS BIGINT) AS delta FROM (SELECT source, count(*) AS n FROM sft_examples GROUP BY 1) a JOIN (SELECT source, count(*) AS n FROM preference_examples GROUP BY 1) b ON a.source = b.source")
def a14_deltas(spark, d):
    one = lambda t, n: table(spark, d, t).groupBy("source").agg(F.count(F.lit(1)).alias(n))
    return one("sft_examples", "before").join(one("preference_examples", "after"), "source").withColumn("delta", F.col("after") - F.col("before"))


@query()
def w12_early_stopping(spark, d):
    """Best value and counters over each user's events in order, as over a run's evaluations."""
    h = table(spark, d, "events").select("user_id", "event_id", "value")
    return evals.early_stopping(h, "user_id", "event_id", "value", 0.1)


@query(f"SELECT doc_id, {_ends('text')} <> text AS padded FROM documents WHERE text IS NOT NULL")
def f01_type_guard(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", (T.squeeze_ends(F.col("text")) != F.col("text")).alias("padded"))
