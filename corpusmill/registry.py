"""Queries of the core: name -> query, name -> equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.core.tables import materialise, table
from corpusmill.functions import hashing
from corpusmill.functions import text as T
from corpusmill.operators import corpus, evals, examples, retrieval, snapshot_diff, snapshots
from corpusmill.plans import prepare

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# SQL counterparts of the text expressions -----------------------------------------------------------

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _norm(x: str) -> str:
    return f"lower({_sq(f"coalesce({x}, '')")})"


def _clean(x: str) -> str:
    return _sq(f"regexp_replace({x}, '\\x00', ' ', 'g')")


def _ends(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_EMAIL, _PHONE, _SSN = (p.replace("(?U)", "", 1) for p in (T.EMAIL, T.PHONE, T.SSN))


def _scrub(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '{_EMAIL}', '[EMAIL]', 'g'), '{_PHONE}', '[PHONE]', 'g'), '{_SSN}', '[SSN]', 'g')"


def _words(x: str) -> str:
    return f"regexp_extract_all({_norm(x)}, '[a-z0-9]+')"


_FLAGS = "(SELECT name AS source, any_value(coalesce(quality_filter, true)) AS q, any_value(coalesce(deduplicate, true)) AS d, any_value(coalesce(pii_scrub, true)) AS p FROM data_sources GROUP BY name)"
_CLEANED = f"""cleaned AS (SELECT doc_id, source, CASE WHEN coalesce(p, true) THEN {_scrub("t")} ELSE t END AS clean_text, coalesce(q, true) AS q, coalesce(d, true) AS d
  FROM (SELECT doc_id, source, {_clean("text")} AS t FROM documents WHERE text IS NOT NULL) LEFT JOIN {_FLAGS} USING (source)),
 judged AS (SELECT *, CASE WHEN q AND NOT (length(clean_text) BETWEEN 128 AND 200000 AND length(regexp_replace(clean_text, '\\PL', '', 'g')) / greatest(length(clean_text), 1) >= 0.2
   AND (length(clean_text) - length(replace(clean_text, 'http', ''))) / 4 <= 100) THEN 'quality_filter' END AS reason FROM cleaned),
 first AS (SELECT clean_text, min(doc_id) AS first_id FROM judged WHERE reason IS NULL AND d GROUP BY 1),
 final AS (SELECT j.*, CASE WHEN reason IS NOT NULL THEN reason WHEN d AND doc_id <> first_id THEN 'duplicate' END AS why FROM judged j LEFT JOIN first USING (clean_text))"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Adds ord, the place from 0 in the order of a unique key."""
    return corpus.running(df.withColumn("one", F.lit(1).cast("long")), ["one"], key).withColumnRenamed("before_one", "ord").drop("one")


# preparation ----------------------------------------------------------------------------------------


@query(f"WITH {_CLEANED} SELECT coalesce(source, '(none)') AS source, count(*) AS docs, CAST(sum(length(clean_text)) AS BIGINT) AS chars FROM final WHERE why IS NULL GROUP BY 1")
def m01_prepared_corpus(spark, d):
    """Normalised, scrubbed, filtered, deduplicated documents by source."""
    rows = prepare.cleaned(table(spark, d, "documents"), table(spark, d, "data_sources"))
    return rows.groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("clean_text")).alias("chars"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders) WHERE ord >= 100 AND ord < 350")
def s08_record_window(spark, d):
    return corpus.record_window(_numbered(table(spark, d, "orders"), "o_orderkey"), F.col("ord"), 100, 250).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders) WHERE ord >= 180 AND ord < 350")
def s09_resumed_window(spark, d):
    skip, take = corpus.resumed_window(100, 250, 80)
    return corpus.record_window(_numbered(table(spark, d, "orders"), "o_orderkey"), F.col("ord"), skip, take).select("o_orderkey")


@query("SELECT source_idx, source, count(*) AS n, count(record_id) AS with_id FROM (SELECT 0 AS source_idx, source, document_id AS record_id FROM documents UNION ALL SELECT 1, source, example_id FROM sft_examples UNION ALL SELECT 2, source, NULL FROM preference_examples) GROUP BY 1, 2")
def s10_multi_source_union(spark, d):
    parts = [table(spark, d, "documents").select("source", F.col("document_id").alias("record_id")), table(spark, d, "sft_examples").select("source", F.col("example_id").alias("record_id")), table(spark, d, "preference_examples").select("source")]
    return corpus.union_sources(parts).groupBy("source_idx", "source").agg(F.count(F.lit(1)).alias("n"), F.count("record_id").alias("with_id"))


@query(f"SELECT doc_id, {_clean('text')} AS clean_text FROM documents WHERE text IS NOT NULL")
def x01_normalize_ws(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.normalize_whitespace(F.col("text")).alias("clean_text"))


@query(f"SELECT doc_id, {_scrub(_clean('text'))} AS clean_text FROM documents WHERE text IS NOT NULL")
def x02_scrub_pii(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.scrub(T.normalize_whitespace(F.col("text"))).alias("clean_text"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {_clean('text')} AS t FROM documents WHERE text IS NOT NULL) WHERE length(t) BETWEEN 128 AND 200000 AND length(regexp_replace(t, '\\PL', '', 'g')) / greatest(length(t), 1) >= 0.2")
def f03_quality_filter(spark, d):
    t = T.normalize_whitespace(F.col("text"))
    return table(spark, d, "documents").where(F.col("text").isNotNull() & T.quality_ok(t, 128, 200_000)).select("doc_id")


@query(f"WITH {_CLEANED} SELECT coalesce(why, 'kept') AS reason, count(*) AS n FROM final GROUP BY 1")
def f05_drop_reasons(spark, d):
    rows = materialise(corpus.clean(table(spark, d, "documents"), table(spark, d, "data_sources")).select("doc_id", "clean_text", "dropped_reason", "deduplicate"), "clean")
    kept = corpus.exact_dedup(rows.where("dropped_reason is null"), "clean_text", [F.col("doc_id")], F.col("deduplicate")).select("doc_id", F.lit("kept").alias("_k"))
    out = rows.select("doc_id", "dropped_reason").join(kept, "doc_id", "left")
    return out.groupBy(F.coalesce("dropped_reason", "_k", F.lit("duplicate")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def w01_exact_dedup(spark, d):
    return corpus.exact_dedup(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "text", [F.col("doc_id")]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source LIKE 'site%' AND text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE source NOT LIKE 'site%' AND text IS NOT NULL)")
def j01_dedup_vs_prior(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", "source")
    return corpus.dedup_against(docs.where("source like 'site%'"), docs.where("source not like 'site%'"), "text").select("doc_id")


@query("SELECT source, count(*) AS consumed, count_if(text IS NOT NULL AND length(text) >= 128) AS accepted FROM documents GROUP BY 1")
def a02_source_progress(spark, d):
    return corpus.progress(table(spark, d, "documents"), "source", F.coalesce(F.length("text") >= 128, F.lit(False)))


@query("SELECT count(*) AS documents, CAST(sum(length(text) + 1) AS BIGINT) AS characters FROM documents WHERE text IS NOT NULL AND length(text) >= 128")
def a03_corpus_size(spark, d):
    return table(spark, d, "documents").where(F.length("text") >= 128).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text") + 1).alias("characters"))


@query("SELECT doc_id FROM (SELECT doc_id, length(text) AS n, sum(length(text)) OVER (ORDER BY doc_id) AS upto FROM documents WHERE text IS NOT NULL) WHERE upto - n < 200000")
def w04_token_budget(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").cast("long").alias("n"))
    return corpus.budget_prefix(rows, {"n": 200_000}, "doc_id").select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, length(text) + 1 AS n, sum(length(text) + 1) OVER (ORDER BY doc_id) AS upto, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE length(text) >= 128) WHERE upto - n < 300000 AND k <= 250")
def w05_doc_char_budget(spark, d):
    rows = table(spark, d, "documents").where(F.length("text") >= 128).select("doc_id", (F.length("text") + 1).cast("long").alias("n"), F.lit(1).cast("long").alias("one"))
    return corpus.budget_prefix(rows, {"n": 300_000, "one": 250}, "doc_id").select("doc_id")


@query("SELECT CAST(floor(ord / 64) AS BIGINT) AS shard, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents) GROUP BY 1")
def k01_shard_sizes(spark, d):
    rows = corpus.shards(_numbered(table(spark, d, "documents").select("doc_id"), "doc_id"), "ord", 64)
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT CAST(floor(ord / 64) AS BIGINT) AS shard, CAST(ord % 64 AS BIGINT) AS row_in_shard, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents) WHERE ord IN (0, 63, 64, 200, 777)")
def j15_index_lookup(spark, d):
    rows = _numbered(table(spark, d, "documents").select("doc_id"), "doc_id").where(F.col("ord").isin(0, 63, 64, 200, 777))
    return corpus.shards(rows, "ord", 64).select("shard", "row_in_shard", "doc_id")


_PACK_SIZES = f"(SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, len({_words('text')}) + 2 AS n FROM documents WHERE text IS NOT NULL)"


@query(
    f"""WITH RECURSIVE s AS {_PACK_SIZES}, f AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS done, CAST(-1 AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS off, CAST(0 AS BIGINT) AS parts
  UNION ALL SELECT s.k, CASE WHEN n > 512 THEN used WHEN used + n > 512 THEN n ELSE used + n END,
   done + CASE WHEN n > 512 THEN CAST(ceil(n / 512) AS BIGINT) WHEN used + n > 512 THEN 1 ELSE 0 END, s.doc_id,
   CASE WHEN n > 512 OR used + n > 512 THEN 0 ELSE used END, CASE WHEN n > 512 THEN CAST(ceil(n / 512) AS BIGINT) ELSE 1 END FROM f JOIN s ON s.k = f.k + 1)
 SELECT (SELECT max(done) + max(CASE WHEN used > 0 AND k = (SELECT max(k) FROM f) THEN 1 ELSE 0 END) FROM f) AS sequences, CAST(sum(parts) AS BIGINT) AS pieces, CAST(sum(CASE WHEN off > 0 THEN 1 ELSE 0 END) AS BIGINT) AS appended FROM f WHERE k > 0"""
)
def w02_pack_rows(spark, d):
    """Next-fit packing in one lane: sequences, pieces of documents, documents appended to an open sequence."""
    rows = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("ord"), (F.size(T.word_tokens(F.col("text"))) + 2).alias("n"), F.lit(0).alias("lane"))
    packed = corpus.next_fit(rows, 512)
    return packed.agg(F.countDistinct("row").alias("sequences"), F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("offset") > 0).alias("appended"))


@query(f"SELECT doc_id, part, CAST(least(512, n - 512 * part) AS BIGINT) AS n FROM (SELECT doc_id, n, unnest(range(CAST(ceil(n / 512) AS BIGINT))) AS part FROM {_PACK_SIZES} WHERE n > 512)")
def w03_long_doc_windows(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", (F.size(T.word_tokens(F.col("text"))) + 2).alias("m")).where("m > 512")
    parts = rows.select("doc_id", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / 512) - 1)).alias("part"))
    return parts.select("doc_id", "part", F.least(F.lit(512), F.col("m") - 512 * F.col("part")).cast("long").alias("n"))


@query(f"SELECT doc_id, CAST(len(w) AS INT) AS n, array_to_string(list_concat(w[1:8], ['<pad>' FOR i IN range(8 - least(len(w), 8))]), ' ') AS padded FROM (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL)")
def x54_pad_ids(spark, d):
    w = T.word_tokens(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(w).alias("n"), F.array_join(F.slice(F.concat(w, F.array_repeat(F.lit("<pad>"), 8)), 1, 8), " ").alias("padded"))


@query(f"SELECT doc_id, CAST(least(len(w), 8) AS INT) AS supervised FROM (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL)")
def x55_label_mask(spark, d):
    lengths = F.transform(T.word_tokens(F.col("text")), lambda x: F.length(x))
    labels = corpus.masked_labels(corpus.pad(lengths, 8, 0), 0)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.filter(labels, lambda x: x != -100)).alias("supervised"))


@query(f"SELECT CAST(sum(len(w)) AS BIGINT) AS tokens, CAST(sum(least(len(w), 64)) AS BIGINT) AS kept_tokens, count(*) AS sequences FROM (SELECT {_words('text')} AS w FROM documents WHERE text IS NOT NULL)")
def a01_token_counts(spark, d):
    n = F.size(T.word_tokens(F.col("text")))
    return table(spark, d, "documents").where("text is not null").agg(F.sum(n).alias("tokens"), F.sum(F.least(n, F.lit(64))).alias("kept_tokens"), F.count(F.lit(1)).alias("sequences"))


# examples -------------------------------------------------------------------------------------------

_MSG = "list_filter(messages, lambda m: trim(coalesce(m.role, '')) <> 'assistant')"


def _sig(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda m: trim(coalesce(m.role, '')) || chr(2) || {_sq(chr(99) + 'oalesce(m.content, ' + chr(39) * 2 + ')')}), chr(1))"


def _sig_col(messages: Column) -> Column:
    """The signature as plain text, for comparison with SQL."""
    kept = F.filter(messages, lambda m: F.trim(F.coalesce(m["role"], F.lit(""))) != "assistant")
    return F.array_join(F.transform(kept, lambda m: F.concat(F.trim(F.coalesce(m["role"], F.lit(""))), F.lit("\x02"), T.squeeze(F.coalesce(m["content"], F.lit(""))))), "\x01")


@query("SELECT example_id, len(messages) AS n, messages[1].role AS first_role FROM sft_examples WHERE len(messages) > 0")
def f07_sft_messages(spark, d):
    m = examples.sft_messages(F.col("messages"))
    return table(spark, d, "sft_examples").withColumn("m", m).where("m is not null").select("example_id", F.size("m").cast("long").alias("n"), F.col("m")[0]["role"].alias("first_role"))


@query("SELECT count(*) AS n, count_if(coalesce(len(prompt) > 0, false) AND chosen IS NOT NULL AND rejected IS NOT NULL) AS valid FROM preference_examples")
def f08_preference_shape(spark, d):
    ok = examples.is_preference(F.col("prompt"), F.col("chosen"), F.col("rejected"))
    return table(spark, d, "preference_examples").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"))


_TOKENS = "CASE m.role WHEN 'system' THEN '<|system|>' WHEN 'user' THEN '<|user|>' WHEN 'assistant' THEN '<|assistant|>' WHEN 'tool' THEN '<|tool|>' END"


@query(f"SELECT example_id, array_to_string(list_transform(messages, lambda m: {_TOKENS} || chr(10) || {_ends(chr(99) + 'oalesce(m.content, ' + chr(39) * 2 + ')')} || chr(10) || '</s>'), chr(10)) AS rendered FROM sft_examples WHERE len(messages) > 0")
def x12_chat_render(spark, d):
    return table(spark, d, "sft_examples").where(F.size("messages") > 0).select("example_id", T.render_chat(F.col("messages")).alias("rendered"))


@query(f"SELECT example_id, coalesce(nullif({_sq('split_group_id')}, ''), sha256(coalesce(source, '') || chr(1) || {_sig(_MSG)})) AS group_id FROM sft_examples WHERE messages IS NOT NULL")
def x43_group_id(spark, d):
    fallback = F.sha2(F.concat(F.coalesce("source", F.lit("")), F.lit("\x01"), _sig_col(F.col("messages"))), 256)
    return table(spark, d, "sft_examples").where("messages is not null").select("example_id", F.coalesce(examples.optional(F.col("split_group_id")), fallback).alias("group_id"))


@query(f"SELECT example_id, {_sig(_MSG)} AS asked, sha256({_sig(_MSG)}) AS asked_hash FROM sft_examples WHERE messages IS NOT NULL")
def x44_prompt_signature(spark, d):
    s = _sig_col(F.col("messages"))
    return table(spark, d, "sft_examples").where("messages is not null").select("example_id", s.alias("asked"), F.sha2(s, 256).alias("asked_hash"))


@query(f"WITH a AS (SELECT DISTINCT {_sig(_MSG)} AS s FROM (SELECT prompt AS messages FROM preference_examples)) SELECT example_id, count(*) AS n FROM sft_examples WHERE {_sig(_MSG)} <> '' AND {_sig(_MSG)} IN (SELECT s FROM a) GROUP BY 1")
def j02_prompt_overlap(spark, d):
    """SFT examples that ask what a preference prompt asks."""
    held = table(spark, d, "preference_examples").select(F.col("prompt").alias("messages"))
    return examples.overlap(table(spark, d, "sft_examples"), held).groupBy("example_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT example_id, coalesce(source, '') AS g FROM sft_examples), g AS (SELECT g, count(*) AS n, sha256('0|sft|' || g) AS h FROM e GROUP BY 1),
 r AS (SELECT *, sum(n) OVER (ORDER BY h) - n AS before, max(h) OVER () AS last FROM g), t AS (SELECT round_even(count(*) * 0.1, 0) AS wanted FROM e)
 SELECT split, count(*) AS n, count(DISTINCT g) AS groups FROM (SELECT e.g, CASE WHEN before < greatest(1, wanted) AND h < last THEN 'validation' ELSE 'train' END AS split FROM e JOIN r USING (g), t) GROUP BY 1"""
)
def w06_group_split(spark, d):
    rows = table(spark, d, "sft_examples").select("example_id", F.coalesce("source", F.lit("")).alias("g"))
    return examples.group_split(rows, "g", 0.1).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("g").alias("groups"))


@query(
    """WITH s AS (SELECT name, format AS kind, coalesce(skip_records, 0) AS start, coalesce(skip_records, 0) + max_records AS stop FROM data_sources)
 SELECT a.kind, a.name AS left_name, b.name AS right_name FROM s a JOIN s b ON a.kind = b.kind AND a.name < b.name AND greatest(a.start, b.start) < least(coalesce(a.stop, 4611686018427387904), coalesce(b.stop, 4611686018427387904))"""
)
def j03_range_overlap(spark, d):
    s = table(spark, d, "data_sources").select("name", F.col("format").alias("kind"), F.coalesce("skip_records", F.lit(0)).alias("start"), (F.coalesce("skip_records", F.lit(0)) + F.col("max_records")).alias("stop"))
    return examples.range_overlaps(s, s, "kind").where("left_name < right_name")


# pages ----------------------------------------------------------------------------------------------

_PAGE = "'<html><head><title> ' || coalesce(page_title, '') || ' &amp; more</title></head><body><h1>' || coalesce(source, '') || '</h1><article><p>' || replace(coalesce(text, ''), chr(10), '</p><p>') || '</p><script>x < 1</script></article></body></html>'"


def _page() -> Column:
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    return F.concat(F.lit("<html><head><title> "), c("page_title"), F.lit(" &amp; more</title></head><body><h1>"), c("source"), F.lit("</h1><article><p>"), F.replace(c("text"), F.lit("\n"), F.lit("</p><p>")), F.lit("</p><script>x < 1</script></article></body></html>"))


@query(f"SELECT doc_id, {_sq('replace(regexp_replace(regexp_extract(h, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1), ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '&amp;' + chr(39) + ', ' + chr(39) + '&' + chr(39) + ')')} AS title FROM (SELECT doc_id, {_PAGE} AS h FROM documents)")
def x06_title(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.html_title(_page()).alias("title"))


@query("SELECT doc_id, source AS headings FROM documents WHERE source IS NOT NULL")
def x07_headings(spark, d):
    return table(spark, d, "documents").where("source is not null").select("doc_id", T.html_headings(_page()).alias("headings"))




@query()
def x09_html_text(spark, d):
    """Text of pages with entities, tags and all kinds of line ends; tested on literal pages."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", T.html_to_text(_page()).alias("page_text"))


@query(
    f"""WITH RECURSIVE p AS (SELECT doc_id, ps, len(ps) AS m FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_sq('x')}), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL)),
 w AS (SELECT doc_id, ps, m, CAST(1 AS BIGINT) AS i, '' AS buf, CAST(0 AS BIGINT) AS done, CAST(0 AS BIGINT) AS longest FROM p
  UNION ALL SELECT doc_id, ps, m, i + 1, CASE WHEN buf = '' THEN ps[i] WHEN length(buf) + 1 + length(ps[i]) > 500 THEN ps[i] ELSE buf || chr(10) || ps[i] END,
   done + CASE WHEN buf <> '' AND length(buf) + 1 + length(ps[i]) > 500 THEN 1 ELSE 0 END, greatest(longest, CASE WHEN buf <> '' AND length(buf) + 1 + length(ps[i]) > 500 THEN length(buf) ELSE 0 END) FROM w WHERE i <= m)
 SELECT doc_id, done + CASE WHEN buf <> '' THEN 1 ELSE 0 END AS chunks, greatest(longest, length(buf)) AS longest FROM w WHERE i = m + 1"""
)
def w14_chunks(spark, d):
    c = T.chunks(F.col("text"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", c.alias("c"))
    return docs.select("doc_id", F.size("c").cast("long").alias("chunks"), F.coalesce(F.array_max(F.transform("c", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(lower({_sq('source')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents WHERE source IS NOT NULL")
def x05_slug(spark, d):
    return table(spark, d, "documents").where("source is not null").select("doc_id", T.slug(F.col("source")).alias("slug"))


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '20[0-9]{2}\\s*[-–]\\s*[0-9]{2}'), lambda y: regexp_replace(y, '\\s*[-–]\\s*', '-')), ',') AS years FROM documents WHERE regexp_matches(text, '20[0-9]{2}\\s*[-–]\\s*[0-9]{2}')")
def x31_school_years(spark, d):
    y = T.school_years(F.col("text"))
    return table(spark, d, "documents").where(F.size(y) > 0).select("doc_id", F.array_join(y, ",").alias("years"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '\\b([A-Z]{2,8}\\s?-?[0-9]{2,4}[A-Z]?)\\b', 1), ',') AS codes FROM documents WHERE regexp_matches(text, '\\b[A-Z]{2,8}\\s?-?[0-9]{2,4}[A-Z]?\\b')")
def x11_course_codes(spark, d):
    c = T.course_codes(F.col("text"))
    return table(spark, d, "documents").where(F.size(c) > 0).select("doc_id", F.array_join(c, ",").alias("codes"))


@query(f"SELECT doc_id, {_ends('split_part(split_part(text, ' + chr(39) + '. ' + chr(39) + ', 1), ' + chr(39) + ' - ' + chr(39) + ', 1)')} AS cut FROM documents WHERE text IS NOT NULL")
def x13_cut_at_stops(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.cut_at(F.col("text"), [". ", " - "]).alias("cut"))


@query("SELECT citation_id, substring(snippet, 1, 1200) AS snippet FROM citations WHERE snippet IS NOT NULL")
def x16_truncate(spark, d):
    return table(spark, d, "citations").where("snippet is not null").select("citation_id", F.substring("snippet", 1, 1200).alias("snippet"))


_URL_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(u, '{p}')" for p in parts) + f" THEN '{kind}'" for parts, kind in snapshots.URL_TYPES) + " ELSE 'generic' END"


@query(f"SELECT {_URL_CASE} AS page_type, count(*) AS n FROM (SELECT coalesce(url, '') || '/' || coalesce(replace(source, '_', '-'), '') AS u FROM documents) GROUP BY 1")
def x26_page_type(spark, d):
    u = F.concat(F.coalesce("url", F.lit("")), F.lit("/"), F.coalesce(F.replace("source", F.lit("_"), F.lit("-")), F.lit("")))
    return table(spark, d, "documents").groupBy(snapshots.url_page_type(u).alias("page_type")).agg(F.count(F.lit(1)).alias("n"))


_POLICIES = [("robotics", "lab", 2), ("museum", "exhibit", 1), ("latin", "language", 0), (" ", "never", 3)]


@query(
    "WITH p(needle, page_type, ord) AS (VALUES ('robotics', 'lab', 2), ('museum', 'exhibit', 1), ('latin', 'language', 0)) SELECT doc_id, coalesce(arg_min(p.page_type, p.ord), 'generic') AS page_type FROM documents LEFT JOIN p ON contains(lower(text), needle) GROUP BY doc_id"
)
def j09_policy_first_match(spark, d):
    return snapshots.first_policy(table(spark, d, "documents"), spark.createDataFrame(_POLICIES, "needle string, page_type string, ord int"), F.col("text"), "doc_id")


# snapshots ------------------------------------------------------------------------------------------


def _folded(x: str) -> str:
    """Words of a text without markup; the only entities in the test tables are blanks and ampersands."""
    plain = f"replace(replace(coalesce({x}, ''), '&nbsp;', ' '), '&amp;', '&')"
    plain = f"regexp_replace({plain}, '<[/!]?[A-Za-z][^<>]*>', ' ', 'g')"
    plain = f"regexp_replace(strip_accents({plain}), '[\\x{{300}}-\\x{{36f}}\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}]', '', 'g')"
    return f"array_to_string(regexp_extract_all(lower({plain}), '[\\pL\\pN]+'), ' ')"


@query(
    f"""WITH s AS (SELECT lower(trim(id)) AS k, id, row_number() OVER (ORDER BY CAST(created_at AS TIMESTAMPTZ), lower(trim(id))) - 1 AS o FROM knowledge_snapshots WHERE completed),
 r AS (SELECT 'courses' AS rt, o, coalesce(institution_id, '') || '/' || upper(regexp_replace(coalesce(code, ''), '[^\\pL\\p{{Nd}}]', '', 'g')) AS key, ingested_at AS t,
   coalesce(CAST(credits AS VARCHAR), '-') || chr(1) || {_folded('title')} || chr(1) || {_folded('description')} AS v FROM courses JOIN s ON lower(trim(snapshot_id)) = s.k
  UNION ALL SELECT 'grounding_results', o, CAST(query_key AS VARCHAR), created_at, trim(coalesce(route, '')) || chr(1) || array_to_string(list_sort(list_distinct(list_transform(hits, lambda h: {_folded('h.title')}))), chr(2))
   FROM grounding_results JOIN s ON lower(trim(snapshot_id)) = s.k),
 l AS (SELECT rt, o, key, arg_max(v, t) AS v FROM r GROUP BY 1, 2, 3),
 d AS (SELECT coalesce(b.rt, a.rt) AS record_table, coalesce(b.o, a.o + 1) AS o, coalesce(b.key, a.key) AS record_key, CASE WHEN a.o IS NULL THEN 'added' WHEN b.o IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' END AS change_kind
  FROM l a FULL JOIN l b ON a.rt = b.rt AND a.key = b.key AND b.o = a.o + 1)
 SELECT record_table, s.id AS snapshot_id, record_key, change_kind FROM d JOIN s USING (o) WHERE o > 0 AND change_kind IS NOT NULL"""
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between consecutive completed snapshots of courses and of grounded answers."""
    t = lambda name: table(spark, sf_dir, name)
    return snapshot_diff.p1_found(t("courses"), t("grounding_results"), t("knowledge_snapshots"))


@query(
    f"""WITH s AS (SELECT lower(trim(id)) AS k, id, row_number() OVER (ORDER BY CAST(created_at AS TIMESTAMPTZ), lower(trim(id))) - 1 AS o FROM knowledge_snapshots WHERE completed),
 r AS (SELECT o, coalesce(institution_id, '') || '/' || upper(regexp_replace(coalesce(code, ''), '[^\\pL\\p{{Nd}}]', '', 'g')) AS key, ingested_at AS t,
   {{'v': coalesce(CAST(credits AS VARCHAR), '-') || chr(1) || {_folded('title')} || chr(1) || {_folded('description')}, 'd': description, 'c': credits}} AS v FROM courses JOIN s ON lower(trim(snapshot_id)) = s.k),
 l AS (SELECT o, key, arg_max(v, t) AS v FROM r GROUP BY 1, 2),
 d AS (SELECT coalesce(b.o, a.o + 1) AS o, coalesce(b.key, a.key) AS record_key, CASE WHEN a.o IS NULL THEN 'added' WHEN b.o IS NULL THEN 'removed' WHEN a.v.v <> b.v.v THEN 'changed' END AS change_kind,
   a.v.d AS old_description, b.v.d AS new_description, a.v.c AS old_credits, b.v.c AS new_credits FROM l a FULL JOIN l b ON a.key = b.key AND b.o = a.o + 1)
 SELECT s.id AS snapshot_id, record_key, change_kind, old_description, new_description, old_credits, new_credits FROM d JOIN s USING (o) WHERE o > 0 AND change_kind IS NOT NULL"""
)
def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed courses with the description and credits before and after."""
    return snapshot_diff.course_changes(table(spark, sf_dir, "courses"), table(spark, sf_dir, "knowledge_snapshots"), ["description", "credits"])


@query("SELECT id, arg_max(title, (ingested_at, title)) AS title, max(ingested_at) AS ingested_at FROM courses WHERE title IS NOT NULL GROUP BY id")
def k08_upsert_last_wins(spark, d):
    rows = table(spark, d, "courses").where("title is not null").select("id", "title", "ingested_at", F.xxhash64("id", "ingested_at").alias("h"))
    first, second = rows.where(F.pmod("h", F.lit(2)) == 0), rows.where(F.pmod("h", F.lit(2)) == 1)
    both = first.withColumn("seq", F.struct("ingested_at", "title")).unionByName(second.withColumn("seq", F.struct("ingested_at", "title")))
    return snapshots.last_wins(both.drop("h"), ["id"], [F.col("seq")]).select("id", "title", "ingested_at")


@query("SELECT institution_id, code, arg_max(id, (length(coalesce(description, '')), length(coalesce(title, '')), id)) AS id FROM courses GROUP BY 1, 2")
def w07_keep_best(spark, d):
    q = [F.length(F.coalesce("description", F.lit(""))), F.length(F.coalesce("title", F.lit(""))), F.col("id")]
    return snapshots.last_wins(table(spark, d, "courses").select("institution_id", "code", "id", "description", "title"), ["institution_id", "code"], q).select("institution_id", "code", "id")


@query("SELECT source, lang, max(doc_id) AS doc_id, min(doc_id) AS pos FROM documents GROUP BY 1, 2")
def w08_last_wins_merge(spark, d):
    rows = table(spark, d, "documents").select("source", "lang", "doc_id", F.col("doc_id").alias("pos"))
    return snapshots.last_wins(rows, ["source", "lang"], [F.col("doc_id")], first_position="pos")


@query("SELECT id, label FROM knowledge_snapshots WHERE completed ORDER BY coalesce(is_current, false) DESC, created_at DESC NULLS LAST, id DESC LIMIT 1")
def w09_latest_snapshot(spark, d):
    return snapshots.latest_snapshot(table(spark, d, "knowledge_snapshots")).select("id", "label")


@query("SELECT id, id = 'snap-maple' AS is_current FROM knowledge_snapshots")
def w10_publish(spark, d):
    return snapshots.publish(table(spark, d, "knowledge_snapshots"), "snap-maple").select("id", "is_current")


@query(
    "SELECT source AS family, count(*) AS n, count(DISTINCT d2) AS documents FROM (SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'new-' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS d2 FROM documents WHERE source IN ('site_news', 'newsletter', 'handbook')) GROUP BY 1"
)
def r07_carry_forward(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("family"), F.col("doc_id").cast("string").alias("document_id"), F.lit("old").alias("snapshot_id"))
    ids = docs.where("cast(document_id as long) % 2 = 0").select(F.col("document_id").alias("old_id"), F.concat(F.lit("new-"), F.col("document_id")).alias("new_id"))
    out = snapshots.carry_forward(docs, ids, "next", ["site_news", "newsletter", "handbook"])
    return out.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("documents"))


_TWO = "a AS (SELECT institution_id || '/' || code AS k, max(credits) AS v, min(institution_id) AS f FROM courses WHERE lower(trim(snapshot_id)) = 'snap-cedar' GROUP BY 1), b AS (SELECT institution_id || '/' || code AS k, max(credits) AS v, min(institution_id) AS f FROM courses WHERE lower(trim(snapshot_id)) = 'snap-finch' GROUP BY 1)"
_STATUS = "CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'changed' END"


def _two(spark, d):
    rows = table(spark, d, "courses").select(F.concat("institution_id", F.lit("/"), "code").alias("k"), "credits", "institution_id", F.lower(F.trim("snapshot_id")).alias("s"))
    one = lambda s: rows.where(F.col("s") == s).groupBy("k").agg(F.max("credits").alias("v"), F.min("institution_id").alias("f"))
    return one("snap-cedar"), one("snap-finch")


@query(f"WITH {_TWO} SELECT coalesce(a.k, b.k) AS k, {_STATUS} AS status FROM a FULL JOIN b ON a.k = b.k")
def j04_snapshot_diff(spark, d):
    return snapshots.diff(*_two(spark, d), "k", "v")


@query(
    f"WITH {_TWO}, s AS (SELECT coalesce(b.f, a.f) AS f, {_STATUS} AS status FROM a FULL JOIN b ON a.k = b.k) SELECT f, count_if(status = 'added') AS added, count_if(status = 'removed') AS removed, count_if(status = 'changed') AS changed, count_if(status = 'unchanged') AS unchanged FROM s GROUP BY 1"
)
def j05_family_diff(spark, d):
    return snapshots.diff_counts(snapshots.diff(*_two(spark, d), "k", "v", "f"), "f")


@query(
    f"""WITH v AS (SELECT upper(regexp_replace(code, '[^A-Za-z0-9]', '', 'g')) AS k, school, {_norm('title')} AS t FROM (SELECT code, max(title) AS title, lower(trim(snapshot_id)) AS school FROM courses WHERE institution_id = 'inst-oakmere' GROUP BY 1, 3)),
 a AS (SELECT k, min(t) AS t FROM v WHERE school = 'snap-quartz' GROUP BY 1), b AS (SELECT k, min(t) AS t FROM v WHERE school = 'snap-finch' GROUP BY 1),
 s AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.t <> b.t THEN 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k WHERE (SELECT count(*) FROM a) > 0 AND (SELECT count(*) FROM b) > 0)
 SELECT k, status FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY k) AS r FROM s WHERE status IS NOT NULL) WHERE r <= 20"""
)
def j06_version_compare(spark, d):
    rows = table(spark, d, "courses").where("institution_id = 'inst-oakmere'").groupBy("code", F.lower(F.trim("snapshot_id")).alias("s")).agg(F.max("title").alias("title"))
    rows = rows.select(F.upper(F.regexp_replace("code", "[^A-Za-z0-9]", "")).alias("k"), "s", T.normalize_text(F.col("title")).alias("t"))
    one = lambda s: rows.where(F.col("s") == s).groupBy("k").agg(F.min("t").alias("t"))
    return snapshots.compare_versions(one("snap-quartz"), one("snap-finch"), "k", ["t"], lambda c: c)


@query("SELECT snapshot_id, array_to_string(list_sort(list_distinct(list(m))), ',') AS modes, bool_and(m NOT IN ('degraded', 'uncitable')) AS citable FROM (SELECT source AS snapshot_id, CASE WHEN length(text) < 60 THEN 'degraded' ELSE 'native' END AS m FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def a16_snapshot_quality(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select(F.col("source").alias("snapshot_id"), F.when(F.length("text") < 60, "degraded").otherwise("native").alias("extraction_quality"))
    return snapshots.quality(rows)


# retrieval ------------------------------------------------------------------------------------------


@query("SELECT id, code FROM (SELECT id, max(code) AS code, max(title) AS title, max(description) AS description FROM courses GROUP BY id) WHERE code ILIKE '%sampling%' OR title ILIKE '%sampling%' OR description ILIKE '%sampling%' ORDER BY id LIMIT 10")
def f11_ilike_search(spark, d):
    rows = table(spark, d, "courses").groupBy("id").agg(*(F.max(c).alias(c) for c in ("code", "title", "description")))
    return retrieval.pattern_search(rows, "sampling", ["code", "title", "description"], "id", 10).select("id", "code")


_ASKED = [(1, "tidal energy"), (2, "clay bodies and close reading"), (3, "market design"), (4, "no such words here"), (5, " ")]


def _lex(f: str) -> str:
    return f"CASE WHEN {_norm(f)} = '' THEN 0 ELSE CASE WHEN contains({_norm(f)}, {_norm('query')}) THEN 8.0 ELSE 0 END + 1.5 * len(list_intersect(list_distinct({_words('query')}), {_words(f)})) END"


@query(
    f"""WITH q(qid, query) AS (VALUES (1, 'tidal energy'), (2, 'clay bodies and close reading'), (3, 'market design'), (4, 'no such words here'), (5, ' ')),
 s AS (SELECT qid, result_id AS ord, CASE WHEN {_norm('query')} = '' THEN 0 ELSE {_lex('title')} + {_lex('content')} END AS score FROM q, (SELECT result_id, query AS title, coalesce(route, '') AS content FROM (SELECT result_id, max(query) AS query, max(route) AS route FROM grounding_results GROUP BY 1)))
 SELECT qid, ord, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM s WHERE score > 0) WHERE rank <= 5"""
)
def x20_lexical_score_topk(spark, d):
    rows = table(spark, d, "grounding_results").groupBy(F.col("result_id").alias("ord")).agg(F.max("query").alias("title"), F.max("route").alias("content"))
    found = retrieval.search(spark.createDataFrame(_ASKED, "qid int, query string"), rows, retrieval.lexical_score, ["title", "content"], 5)
    return found.select("qid", "ord", "score", F.col("rank").cast("long").alias("rank"))


@query()
def x20_fuzzy_score_topk(spark, d):
    rows = table(spark, d, "grounding_results").groupBy(F.col("result_id").alias("ord")).agg(F.max("query").alias("title"))
    found = retrieval.search(spark.createDataFrame(_ASKED, "qid int, query string"), rows, retrieval.fuzzy_score, ["title"], 5)
    return found.select("qid", "ord", F.round("score", 9).alias("score"), "rank")


@query("SELECT query_key, source_id, min(result_id) AS first_result FROM citations JOIN (SELECT DISTINCT result_id, query_key FROM grounding_results) USING (result_id) GROUP BY 1, 2")
def t05_ordered_dedup(spark, d):
    g = table(spark, d, "grounding_results").select("result_id", "query_key").distinct()
    hits = table(spark, d, "citations").select("result_id", "source_id").join(g, "result_id")
    return retrieval.ordered_distinct(hits, ["query_key", "source_id"], "result_id").select("query_key", "source_id", F.col("result_id").alias("first_result"))


@query(
    "WITH h AS (SELECT query_key AS qid, result_id, max(route) AS route FROM grounding_results GROUP BY 1, 2), s AS (SELECT *, CASE WHEN route IS NULL THEN 2 WHEN route IN ('handbook', 'faculty') THEN 0 ELSE 1 END AS st FROM h) SELECT qid, min(st) AS stage_rank, count_if(st = m) AS n FROM (SELECT *, min(st) OVER (PARTITION BY qid) AS m FROM s) GROUP BY 1"
)
def cascade_first_stage(spark, d):
    h = table(spark, d, "grounding_results").groupBy(F.col("query_key").alias("qid"), "result_id").agg(F.max("route").alias("route"))
    h = h.withColumn("stage_rank", F.when(F.col("route").isNull(), 2).when(F.col("route").isin("handbook", "faculty"), 0).otherwise(1))
    return retrieval.first_stage(h).groupBy("qid").agg(F.min("stage_rank").alias("stage_rank"), F.count(F.lit(1)).alias("n"))


_RULES = [("handbook_policy", 5, ["handbook", "policy", "attendance"]), ("faculty", 4, ["faculty", "teacher", "dean", "who teaches"]), ("course_catalog", 3, ["course", "catalog", "prereq", "compare"]), ("athletics", 4, ["team", "season", "coach", "game"])]


def _kw(words: list[str], n: int) -> str:
    return "CASE WHEN " + " OR ".join(f"contains(l, '{w}')" for w in words) + f" THEN {n} ELSE 0 END"


@query(
    f"""WITH q AS (SELECT result_id, max(query) AS query FROM grounding_results WHERE query IS NOT NULL GROUP BY 1), p AS (SELECT result_id, list_reverse_sort([{', '.join(f"{{'score': {_kw(w, n) + (" + CASE WHEN regexp_matches(query, '[A-Z]{2,8} [0-9]{2,4}') THEN 5 ELSE 0 END" if r == 'course_catalog' else '')}, 'route': '{r}'}}" for r, n, w in _RULES)}]) AS o FROM (SELECT *, lower(query) AS l FROM q))
 SELECT result_id, CASE WHEN o[1].score > 0 THEN o[1].route ELSE 'chat' END AS route, CAST(greatest(o[1].score, 0) AS INT) AS score, o[1].score > 0 AND (o[1].score < 4 OR (o[2].score > 0 AND o[1].score - o[2].score <= 1)) AS low_confidence FROM p"""
)
def x24_router(spark, d):
    q = table(spark, d, "grounding_results").where("query is not null").groupBy("result_id").agg(F.max("query").alias("query"))
    r = retrieval.route(F.col("query"), _RULES, patterns={"course_catalog": (5, "[A-Z]{2,8} [0-9]{2,4}")})
    return q.select("result_id", r.alias("r")).select("result_id", "r.route", "r.score", "r.low_confidence")


@query("SELECT code FROM courses WHERE lower(trim(snapshot_id)) = 'snap-quartz' INTERSECT SELECT code FROM courses WHERE lower(trim(snapshot_id)) = 'snap-finch'")
def u02_intersect(spark, d):
    c = table(spark, d, "courses").withColumn("s", F.lower(F.trim("snapshot_id")))
    return c.where("s = 'snap-quartz'").select("code").intersect(c.where("s = 'snap-finch'").select("code"))


@query("SELECT code FROM courses WHERE lower(trim(snapshot_id)) = 'snap-finch' EXCEPT SELECT code FROM courses WHERE lower(trim(snapshot_id)) = 'snap-quartz'")
def u03_except(spark, d):
    c = table(spark, d, "courses").withColumn("s", F.lower(F.trim("snapshot_id")))
    return c.where("s = 'snap-finch'").select("code").subtract(c.where("s = 'snap-quartz'").select("code"))


# evaluation -----------------------------------------------------------------------------------------


@query(
    f"""WITH t AS (SELECT doc_id, {_ends('text')} AS t FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, regexp_replace(t, '{_WS}', '', 'g') AS d, list_filter(regexp_split_to_array(t, '{_WS}+'), lambda x: x <> '') AS raw FROM t),
 w AS (SELECT *, list_transform(raw, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')) AS p FROM r)
 SELECT doc_id, round(CASE WHEN length(d) > 0 THEN length(regexp_replace(d, '\\PL', '', 'g')) / length(d) ELSE 0 END, 4) AS alpha_ratio, CAST(len(raw) AS INT) AS tokens, round(CASE WHEN len(raw) > 0 THEN len(list_filter(p, lambda x: length(x) <= 2)) / len(raw) ELSE 0 END, 4) AS short_fragment_ratio,
  round(CASE WHEN len(list_filter(p, lambda x: x <> '')) > 0 THEN len(list_distinct(list_filter(p, lambda x: x <> ''))) / len(list_filter(p, lambda x: x <> '')) ELSE 0 END, 4) AS unique_token_ratio FROM w"""
)
def x21_generation_quality(spark, d):
    rows = evals.with_generation_quality(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "text")
    return rows.select("doc_id", "alpha_ratio", "tokens", "short_fragment_ratio", "unique_token_ratio")


@query()
def w11_repeated_run(spark, d):
    rows = evals.with_generation_quality(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.col("repeated_token_run").alias("longest_run"), "separator_bursts")


_SCORED = f"(SELECT item_id, pass_score, requires_citation, reference, CASE WHEN reference IS NOT NULL THEN 1.0 ELSE 0.0 END + CASE WHEN len(expected_substrings) > 0 THEN len(list_filter(expected_substrings, lambda p: contains(lower(coalesce(reference, '')), lower(p)))) / len(expected_substrings) ELSE 0.0 END AS score FROM assistant)"


@query(f"SELECT item_id, CAST(score AS DOUBLE) AS score, coalesce(score >= coalesce(pass_score, 1.0), false) AS passed FROM {_SCORED}")
def x23_assistant_score(spark, d):
    rows = table(spark, d, "assistant").withColumn("score", evals.answer_score(F.col("reference"), F.col("reference"), F.col("expected_substrings")))
    return rows.select("item_id", "score", (F.col("score") >= F.coalesce("pass_score", F.lit(1.0))).alias("passed"))


@query(f"SELECT coalesce(avg(score), 0) AS avg_score, count_if(score >= coalesce(pass_score, 1.0)) / greatest(count(*), 1) AS pass_rate, count_if(coalesce(requires_citation, false)) / greatest(count(*), 1) AS citation_rate, count(*) AS n FROM {_SCORED}")
def a05_assistant_summary(spark, d):
    rows = x23_assistant_score(spark, d).join(table(spark, d, "assistant").select("item_id", "requires_citation"), "item_id")
    return rows.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"), evals.rate(F.col("passed")).alias("pass_rate"), evals.rate(F.coalesce("requires_citation", F.lit(False))).alias("citation_rate"), F.count(F.lit(1)).alias("n"))


@query("SELECT source_type, CASE WHEN coalesce(sum(hit_rank), 0) > 0 THEN sum(coalesce(length(snippet), 0) * hit_rank) / sum(hit_rank) ELSE 0 END AS mean_length FROM citations GROUP BY 1")
def a04_weighted_mean(spark, d):
    rows = table(spark, d, "citations").select("source_type", "hit_rank", F.coalesce(F.length("snippet"), F.lit(0)).cast("double").alias("v"))
    return rows.groupBy("source_type").agg(evals.weighted_mean("v", "hit_rank").alias("mean_length"))


@query(
    "WITH r AS (SELECT route, len(hits) AS h, len(list_filter(hits, lambda x: contains(lower(x.title), 'a'))) AS a FROM grounding_results) SELECT lane, metric, count(v) AS n, coalesce(avg(v), 0) AS mean FROM (SELECT 'retrieval' AS lane, 'hits' AS metric, CAST(h AS DOUBLE) AS v FROM r UNION ALL SELECT 'retrieval', 'with_a', CAST(a AS DOUBLE) FROM r UNION ALL SELECT 'router', 'routed', CAST(CASE WHEN route IS NOT NULL THEN 1 ELSE 0 END AS DOUBLE) FROM r) GROUP BY 1, 2"
)
def a07_lanes(spark, d):
    rows = table(spark, d, "grounding_results").select(F.size("hits").alias("h"), F.size(F.filter("hits", lambda x: F.contains(F.lower(x["title"]), F.lit("a")))).alias("a"), F.col("route").isNotNull().cast("int").alias("r"))
    return evals.lanes(rows, {"retrieval": ("hits=h", "with_a=a"), "router": ("routed=r",)})


@query(
    "SELECT coalesce(lower(trim(snapshot_id)), '(none)') AS snapshot, count(*) AS queries, count_if(coalesce(route, '') <> '') AS router_triggers, count_if(len(hits) > 0) AS retrieval_hits, CASE WHEN count_if(coalesce(route, '') <> '') > 0 THEN count_if(coalesce(route, '') <> '' AND len(hits) > 0) / count_if(coalesce(route, '') <> '') END AS hit_rate FROM grounding_results GROUP BY 1"
)
def a08_retrieval_audit(spark, d):
    routed, hit = F.coalesce("route", F.lit("")) != "", F.coalesce(F.size("hits") > 0, F.lit(False))
    rows = table(spark, d, "grounding_results").groupBy(F.coalesce(F.lower(F.trim("snapshot_id")), F.lit("(none)")).alias("snapshot"))
    return rows.agg(F.count(F.lit(1)).alias("queries"), F.count_if(routed).alias("router_triggers"), F.count_if(hit).alias("retrieval_hits"), evals.guarded(F.count_if(routed & hit), F.count_if(routed)).alias("hit_rate"))


@query(
    """WITH m AS (SELECT 'docs' AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'null_share', avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0.0 END) FROM documents),
 t(metric, kind, threshold) AS (VALUES ('docs', 'minimum', 100.0), ('null_share', 'maximum', 0.001), ('missing', 'minimum', 0.0)) SELECT t.metric, kind, CAST(threshold AS DOUBLE) AS threshold, value, coalesce(CASE kind WHEN 'minimum' THEN value >= threshold WHEN 'maximum' THEN value <= threshold ELSE value = threshold END, false) AS passed FROM t LEFT JOIN m ON t.metric = m.metric"""
)
def a12_release_gates(spark, d):
    docs = table(spark, d, "documents")
    m = docs.agg(F.count(F.lit(1)).cast("double").alias("docs"), F.avg(F.col("text").isNull().cast("double")).alias("null_share"))
    metrics = m.select(F.explode(F.create_map(F.lit("docs"), "docs", F.lit("null_share"), "null_share")).alias("metric", "value"))
    limits = spark.createDataFrame([("docs", "minimum", 100.0), ("null_share", "maximum", 0.001), ("missing", "minimum", 0.0)], "metric string, kind string, threshold double")
    return evals.gates(metrics, limits)


@query("SELECT source, count(*) AS examples, 1.0 / count(*) AS per_example_swing, count(*) < 8 AS warned FROM documents GROUP BY 1")
def a13_reliability(spark, d):
    rows = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("examples"))
    return rows.select("source", "examples", *(c.alias(n) for n, c in evals.reliability(F.col("examples")).items()))


@query("SELECT round(avg(ln(1 + exp(-x))), 9) AS loss, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(avg(x), 9) AS margin FROM (SELECT 0.1 * (ln(1 + length(chosen)) - ln(1 + length(rejected))) AS x FROM preference_examples WHERE chosen IS NOT NULL AND rejected IS NOT NULL)")
def a21_preference_metrics(spark, d):
    rows = table(spark, d, "preference_examples").where("chosen is not null and rejected is not null")
    m = evals.preference_metrics(F.log(1 + F.length("chosen")), F.log(1 + F.length("rejected")))
    return rows.agg(*(F.round(c, 9).alias(n) for n, c in m.items()))


@query("SELECT event_type, round(exp(least(avg(value) / 20, 20)), 9) AS perplexity FROM events GROUP BY 1")
def a20_perplexity(spark, d):
    return table(spark, d, "events").withColumn("loss", F.col("value") / 20).groupBy("event_type").agg(F.round(evals.perplexity("loss"), 9).alias("perplexity"))


@query(f"SELECT item_id, coalesce(list_filter(messages, lambda m: m.role = 'user')[-1].content, '') AS asked FROM assistant")
def w15_last_user(spark, d):
    return table(spark, d, "assistant").select("item_id", T.last_user(F.col("messages")).alias("asked"))


@query()
def x40_document_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", hashing.blake2b_hex("text").alias("document_hash"))


# relational coverage on the star schema -------------------------------------------------------------


@query(
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"
)
def tpch_pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count(F.lit(1)).alias("count_order"))


@query("SELECT c_mktsegment, o_orderkey, o_totalprice FROM (SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r <= 5")
def tpch_top_orders(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 5").select("c_mktsegment", "o_orderkey", "o_totalprice")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_by_hour(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def queries() -> dict[str, Query]:
    import corpusmill.more_queries  # noqa: F401  registers itself

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
