"""Benchmark runs over tables of items with responses: rates, lanes, audits, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import evals


def scored(items: DataFrame, response: str = "response") -> DataFrame:
    """Adds exact, cited and abstained; items: (response, expects_abstention?, expected_course_codes?, expected_substrings?, expected_any_substrings?), missing columns ask nothing."""
    none = F.lit(None).cast("array<string>")
    c = lambda n: F.col(n) if n in items.columns else none
    wants = F.col("expects_abstention") if "expects_abstention" in items.columns else F.lit(False)
    r = F.coalesce(F.col(response), F.lit(""))
    exact = evals.grounded_exact(r, wants, [c("expected_course_codes"), c("expected_substrings")], c("expected_any_substrings"))
    return items.withColumns({"exact": exact, "cited": evals.cites(r), "abstained": evals.abstains(r)})


def summary(scored_items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(.., examples, exactness, citation_rate, abstention_rate, per_example_swing, warned)."""
    out = scored_items.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("examples"), evals.rate(F.col("exact")).alias("exactness"), evals.rate(F.col("cited")).alias("citation_rate"), evals.rate(F.col("abstained")).alias("abstention_rate"))
    return out.withColumns(evals.reliability(F.col("examples")))


def retrieval_audit(items: DataFrame, triggered: Column, hit: Column, present: Column, answered: Column) -> DataFrame:
    """Counts and guarded rates of a retrieval run; present: the answer should be found, answered: the response claims one."""
    missing = ~present
    out = items.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(triggered).alias("router_triggers"), F.count_if(present).alias("present_queries"), F.count_if(missing).alias("missing_queries"), F.count_if(hit).alias("retrieval_hits"),
        F.count_if(~hit).alias("retrieval_misses"), F.count_if(present & ~hit).alias("retrieval_false_negatives"), F.count_if(missing & hit).alias("missing_with_hits"), F.count_if(missing & ~answered).alias("true_missing_answers"),
        F.count_if(missing & ~hit & answered).alias("hallucinations_after_no_hit"),
    )
    g = lambda a, b: evals.guarded(F.col(a), F.col(b))
    return out.withColumns(
        {
            "router_trigger_rate": g("router_triggers", "queries"), "retrieval_hit_rate": g("retrieval_hits", "queries"), "retrieval_false_negative_rate": g("retrieval_false_negatives", "present_queries"),
            "present_query_hit_rate": evals.guarded(F.col("present_queries") - F.col("retrieval_false_negatives"), F.col("present_queries")), "true_missing_rate": g("true_missing_answers", "missing_queries"), "hallucination_rate": g("hallucinations_after_no_hit", "missing_queries"),
        }
    )


def route_audit(items: DataFrame, expected: str, fanout: str, route: str) -> DataFrame:
    """Counts of expected, found and missed routes; items that expect only 'chat' are not grounded."""
    grounded = ~((F.size(expected) == 1) & (F.col(expected)[0] == "chat"))
    found = F.arrays_overlap(expected, fanout)
    out = items.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(grounded).alias("expected_grounded_queries"), F.count_if(grounded & found).alias("route_true_positives"), F.count_if(grounded & ~found).alias("route_false_negatives"),
        F.count_if(~F.array_contains(F.col(expected), F.col(route))).alias("mismatched_routes"),
    )
    return out.withColumn("route_false_negative_rate", evals.guarded(F.col("route_false_negatives"), F.col("expected_grounded_queries")))


def compared(before: DataFrame, after: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, before, after, delta) of two result tables."""
    long = lambda df, n: df.select(key, F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))))).alias("metric", n))
    return long(before, "before").join(long(after, "after"), [key, "metric"], "full_outer").withColumn("delta", F.col("after") - F.col("before"))
