"""Batch retrieval: pattern search, lexical and fuzzy scores, stable top-k, ordered deduplication, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.hashing import sequence_ratio

_SUBSTRING, _TOKEN = 8.0, 1.5


def pattern_search(rows: DataFrame, pattern: str, columns: list[str], order: str, limit: int) -> DataFrame:
    """Rows with the pattern in any column, case aside ('%' and '_' in it stay wildcards); the first `limit` by `order`."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c).ilike(f"%{pattern}%"), F.lit(False))
    return rows.where(test).orderBy(order).limit(limit)


def lexical_score(query: Column, fields: list[Column]) -> Column:
    """8 for a field that holds the query, 1.5 for each distinct query word in it, over all non-empty fields."""
    q = T.normalize_text(query)
    words = F.array_distinct(T.word_tokens(query))
    score = F.lit(0.0)
    for f in fields:
        h = T.normalize_text(f)
        part = F.when(F.contains(h, q), _SUBSTRING).otherwise(0.0) + _TOKEN * F.size(F.array_intersect(words, T.word_tokens(f)))
        score = score + F.when(h != "", part).otherwise(0.0)
    return F.when(q == "", 0.0).otherwise(score)


def fuzzy_score(query: Column, fields: list[Column]) -> Column:
    """lexical_score plus the similarity of each field's beginning, for queries of five characters and more."""
    q = T.normalize_text(query)
    score = lexical_score(query, fields)
    for f in fields:
        h = T.normalize_text(f)
        begin = F.substring(h, F.lit(1), F.greatest(F.length(q) * 2, F.lit(32)))
        score = score + F.when((F.length(q) >= 5) & (h != ""), sequence_ratio(q, begin)).otherwise(0.0)
    return score


def search(queries: DataFrame, rows: DataFrame, score: "callable", fields: list[str], k: int, *, qid: str = "qid", query: str = "query", ord_: str = "ord", min_score: float = 0.0, block: int = 2_000) -> DataFrame:
    """The k best rows of each query, ties in scan order.

    Queries are a stated set; they go to the rows in blocks of about `block`, and top k is kept per
    partition of rows first, so what is shuffled is k rows a query and partition.
    """
    n_blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(n_blocks):
        part = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64(qid), F.lit(n_blocks)) == b)
        scored = rows.join(F.broadcast(part), F.lit(True)).withColumn("score", score(F.col(query), [F.col(f) for f in fields])).where(F.col("score") > min_score)
        best = scored.withColumn("_p", F.spark_partition_id())
        local = Window.partitionBy(qid, "_p").orderBy(F.col("score").desc(), F.col(ord_))
        best = best.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k).drop("_r", "_p")
        out = best if out is None else out.unionByName(best)
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), F.col(ord_))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prefer_titles(hits: DataFrame, preferred: Column, k: int, *, qid: str = "qid", rank: str = "rank") -> DataFrame:
    """Where a query has hits with a preferred title only those, else all; the first k by rank."""
    any_ = F.max(preferred.cast("int")).over(Window.partitionBy(qid))
    kept = hits.withColumn("_any", any_).where((F.col("_any") == 0) | preferred).drop("_any")
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(qid).orderBy(rank))).where(F.col("_r") <= k).drop("_r")


def ordered_distinct(hits: DataFrame, key: list[str], ord_: str, limit: int | None = None, within: list[str] | None = None) -> DataFrame:
    """The first hit of each key, in order; at most `limit` within each group."""
    from corpusmill.operators.snapshots import last_wins

    out = last_wins(hits, [*(within or []), *key], [-F.col(ord_)])
    if limit is None:
        return out
    w = Window.partitionBy(*(within or [F.lit(1)])).orderBy(ord_)
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def first_stage(hits: DataFrame, stage: str = "stage_rank", qid: str = "qid") -> DataFrame:
    """Fallback cascade: of each query only the hits of its first stage that has any."""
    least = F.min(stage).over(Window.partitionBy(qid))
    return hits.withColumn("_least", least).where(F.col(stage) == F.col("_least")).drop("_least")


def route(text: Column, rules: list[tuple[str, int, list[str]]], *, patterns: dict[str, tuple[int, str]] | None = None, fanout: int = 2) -> Column:
    """Keyword routing as one expression: struct(route, score, candidates, fanout, low_confidence).

    rules: (route, points, keywords), the points counting once if any keyword stands in the lower-cased
    text; patterns: route -> (points, regular expression on the text). The best route is the last by
    (score, name); confidence is low below 4 points or with a second within one point.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    points: dict[str, Column] = {}
    for name, n, words in rules:
        points[name] = points.get(name, F.lit(0)) + F.when(T.contains_any(lowered, words), n).otherwise(0)
    for name, (n, pattern) in (patterns or {}).items():
        points[name] = points.get(name, F.lit(0)) + F.when(F.rlike(F.coalesce(text, F.lit("")), F.lit(pattern)), n).otherwise(0)
    ordered = F.sort_array(F.array(*(F.struct(p.alias("score"), F.lit(n).alias("route")) for n, p in points.items())), asc=False)
    top, second = ordered[0], ordered[1]["score"]
    low = (top["score"] < 4) | ((second > 0) & (top["score"] - second <= 1))
    candidates = F.transform(F.filter(ordered, lambda x: x["score"] > 0), lambda x: x["route"])
    none = F.array().cast("array<string>")
    return F.when(
        top["score"] > 0,
        F.struct(top["route"].alias("route"), top["score"].alias("score"), candidates.alias("candidates"), F.when(low, F.slice(candidates, 1, fanout)).otherwise(F.array(top["route"])).alias("fanout"), low.alias("low_confidence")),
    ).otherwise(F.struct(F.lit("chat").alias("route"), F.lit(0).alias("score"), none.alias("candidates"), none.alias("fanout"), F.lit(False).alias("low_confidence")))


def course_code_terms(text: Column) -> Column:
    """Search terms of a text: variants of its course codes first (as written, spaced, joined), the text last, each once."""
    codes = F.regexp_extract_all(text, F.lit(r"(?i)\b[A-Z]{2,8}\s?-?\d{2,4}[A-Z]?\b"), 0)
    letters = lambda c: F.upper(F.regexp_extract(c, "(?i)^[a-z]+", 0))
    digits = lambda c: F.upper(F.regexp_extract(c, r"(?i)\d+[a-z]?$", 0))
    variants = F.flatten(F.transform(codes, lambda c: F.array(c, F.concat(letters(c), F.lit(" "), digits(c)), F.concat(letters(c), digits(c)))))
    return F.array_distinct(F.concat(variants, F.array(text)))
