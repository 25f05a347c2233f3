"""Evaluation analytics: scorers as columns, guarded aggregates, audits, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def guarded(num: Column, den: Column) -> Column:
    """num / den, null where den is 0."""
    return F.when(den > 0, num / den)


def weighted_mean(value: str, weight: str) -> Column:
    """sum(value * weight) / sum(weight), 0 for no weight."""
    w = F.coalesce(F.sum(weight), F.lit(0)).cast("double")
    return F.when(w > 0, F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col(weight)) / w).otherwise(F.lit(0.0))


def rate(flag: Column) -> Column:
    """Share of rows with the flag; 0 of none."""
    return F.count_if(flag) / F.greatest(F.count(F.lit(1)), F.lit(1))


def _parts(text: Column) -> dict[str, Column]:
    """The steps from a text to its words, each by the one before."""
    return {"t": T.squeeze_ends(F.coalesce(text, F.lit("")))} | {
        "dense": lambda c: F.regexp_replace(c["t"], T.WS, ""),
        "raw": lambda c: F.filter(F.split(c["t"], T.WS + "+"), lambda x: x != ""),
        "plain": lambda c: F.transform(c["raw"], lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")),
        "words": lambda c: F.filter(c["plain"], lambda x: x != ""),
    }


def _metrics(c: dict[str, Column]) -> dict[str, Column]:
    t, dense, raw, plain, words = (c[k] for k in ("t", "dense", "raw", "plain", "words"))
    n = F.length(dense)
    ratio = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 4), F.lit(0.0))
    run = F.aggregate(
        words,
        F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(1).alias("top")),
        lambda s, x: F.struct(x.alias("last"), F.when(s["last"] == x, s["run"] + 1).otherwise(1).alias("run"), F.greatest(s["top"], F.when(s["last"] == x, s["run"] + 1).otherwise(1)).alias("top")),
        lambda s: s["top"],
    )
    return {
        "alpha_ratio": ratio(T.letters(dense), n),
        "comma_ratio": ratio(T.occurrences(t, ","), n),
        "separator_bursts": F.regexp_count(t, F.lit(r"([,./>\-])\1{2,}")),
        "tokens": F.size(raw),
        "short_fragment_ratio": ratio(F.size(F.filter(plain, lambda x: F.length(x) <= 2)), F.size(raw)),
        "punctuation_suffix_ratio": ratio(F.size(F.filter(raw, lambda x: F.rlike(x, F.lit(r"[,./>\-]$")))), F.size(raw)),
        "unique_token_ratio": ratio(F.size(F.array_distinct(words)), F.size(words)),
        "repeated_token_run": run,
    }


def generation_quality(text: Column) -> dict[str, Column]:
    """Form statistics of a generated text, ratios to four places."""
    c: dict[str, Column] = {}
    for name, step in _parts(text).items():
        c[name] = step if isinstance(step, Column) else step(c)
    return _metrics(c)


def with_generation_quality(df: DataFrame, text: str) -> DataFrame:
    """df and the statistics of a text column; the steps are projections of their own, so none is computed twice."""
    c: dict[str, Column] = {}
    for name, step in _parts(F.col(text)).items():
        df = df.withColumn(f"__mill_{name}", step(c) if not isinstance(step, Column) else step)
        c[name] = F.col(f"__mill_{name}")
    return df.withColumns(_metrics(c)).drop(*(f"__mill_{n}" for n in c))


#: closing phrases of an answer that says nothing, and of one that abstains (fixed values)
FILLERS = ["what would you like to work on", "what would you like help with", "how can i help today", "tell me what you want to figure out"]
ABSTENTIONS = [
    "i don't know", "i do not know", "not enough information", "insufficient information", "i cannot confirm", "i can't confirm", "could not find", "couldn't find", "cannot verify", "don't want to guess", "not listed",
]


def cites(response: Column) -> Column:
    return T.contains_any(F.lower(response), ["[source:", "<|citation|>"])


def abstains(response: Column) -> Column:
    return T.contains_any(F.lower(response), ABSTENTIONS)


def degenerate_reasons(text: Column) -> Column:
    """Names of the form faults of a generated text, in order; from the statistics of generation_quality."""
    q = generation_quality(text)
    dense = F.length(F.regexp_replace(T.squeeze_ends(F.coalesce(text, F.lit(""))), T.WS, ""))
    words = F.size(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), T.WS + "+"), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")), lambda x: x != ""))
    faults = [
        ("separator_spam", q["separator_bursts"] >= 2), ("low_alphabetic_ratio", (dense >= 40) & (q["alpha_ratio"] < 0.45)), ("too_many_short_fragments", (q["tokens"] >= 12) & (q["short_fragment_ratio"] > 0.55)),
        ("malformed_token_dump", (q["tokens"] >= 12) & (q["punctuation_suffix_ratio"] > 0.55)), ("repeated_token_burst", q["repeated_token_run"] >= 4), ("comma_spam", (dense >= 40) & (q["comma_ratio"] > 0.12)), ("low_token_variety", (words >= 12) & (q["unique_token_ratio"] < 0.3)),
    ]
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in faults)), lambda x: x.isNotNull())


def repeated_marks(text: Column) -> Column:
    """Whether one punctuation mark stands five times on end, blanks aside."""
    return F.rlike(text, F.lit(r"([,.;:!?])(?:\s*+\1){4}"))  # not {4,}: the matcher recurses once a repeat, and a long run overflows the stack


def repeated_connectors(text: Column) -> Column:
    """Whether "and" or "or" stands four times on end."""
    return F.rlike(F.lower(text), F.lit(r"\b(and|or)\b(?:\s++\1){3}"))


def answer_score(response: Column, reference: Column, expected: Column, forbidden: Column | None = None, wants_citation: Column | None = None) -> Column:
    """1 for an equal reference, the share of expected parts, less one a forbidden part, less the form penalties; never below 0.

    A null reference or list asks nothing. With wants_citation, half a point for or against.
    """
    r = F.coalesce(response, F.lit(""))
    score = F.when(T.squeeze_ends(r) == T.squeeze_ends(reference), 1.0).otherwise(0.0) + T.matched_share(r, expected)
    if forbidden is not None:
        score = score - F.coalesce(F.size(F.filter(forbidden, lambda p: F.contains(F.lower(r), F.lower(p)))), F.lit(0))
    score = score - F.when(repeated_marks(r) | repeated_connectors(r), 2.0).otherwise(0.0) - F.when(T.contains_any(F.lower(r), FILLERS), 1.0).otherwise(0.0) - F.when(T.contains_any(r, ["</s>", "<|assistant|>", "<|user|>"]), 2.0).otherwise(0.0)
    if wants_citation is not None:
        score = score + F.when(F.coalesce(wants_citation, F.lit(False)), F.when(cites(r), 0.5).otherwise(-0.5)).otherwise(0.0)
    return F.greatest(score, F.lit(0.0))


def grounded_exact(response: Column, expects_abstention: Column, all_of: list[Column], any_of: Column) -> Column:
    """Whether an answer has all parts of every list and one of any_of (or abstains where it should); without any list, whether it says anything."""
    r = F.lower(F.coalesce(response, F.lit("")))
    none = F.array().cast("array<string>")
    lists = [F.coalesce(x, none) for x in all_of]
    some = F.coalesce(any_of, none)
    ok = F.lit(True)
    for x in lists:
        ok = ok & F.forall(x, lambda p: F.contains(r, F.lower(p)))
    ok = ok & ((F.size(some) == 0) | F.exists(some, lambda p: F.contains(r, F.lower(p))))
    asked = F.size(some)
    for x in lists:
        asked = asked + F.size(x)
    return F.when(F.coalesce(expects_abstention, F.lit(False)), abstains(r)).when(asked == 0, T.squeeze_ends(r) != "").otherwise(ok)


def early_stopping(history: DataFrame, by: str, step: str, value: str, min_delta: float = 0.0) -> DataFrame:
    """(.., best, best_step, no_improvement, worsening) after each evaluation of a run, in step order; null values change nothing.

    A fold over a run's evaluations, which are few; runs are folded side by side.
    """
    import math

    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(step).reset_index(drop=True)
        best, best_step, last, flat, worse, rows = math.inf, None, math.nan, 0, 0, []
        for s, v in zip(pdf[step], pdf[value]):
            if v is not None and not math.isnan(v):
                if v < best - min_delta:
                    best, best_step, flat = v, s, 0
                else:
                    flat += 1
                worse = worse + 1 if not math.isnan(last) and v > last else 0
                last = v
            rows.append((None if math.isinf(best) else best, best_step, flat, worse))
        out = pdf[[by, step, value]].copy()
        out[["best", "best_step", "no_improvement", "worsening"]] = pd.DataFrame(rows, columns=["best", "best_step", "no_improvement", "worsening"])
        return out

    kinds = dict(history.dtypes)
    return history.select(by, step, value).groupBy(by).applyInPandas(fold, f"{by} {kinds[by]}, {step} {kinds[step]}, {value} {kinds[value]}, best double, best_step {kinds[step]}, no_improvement long, worsening long")


def lanes(results: DataFrame, names: dict[str, tuple[str, ...]], by: list[str] | None = None) -> DataFrame:
    """Unpivots score columns lane -> (metric columns) to (lane, metric, n, mean) over all rows."""
    rows = [F.struct(F.lit(lane).alias("lane"), F.lit(metric).alias("metric"), F.col(column).cast("double").alias("value")) for lane, columns in names.items() for metric, column in (c.split("=") for c in columns)]
    long = results.select(*(by or []), F.explode(F.array(*rows)).alias("x")).select(*(by or []), "x.*")
    return long.groupBy(*(by or []), "lane", "metric").agg(F.count("value").alias("n"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, kind, threshold, value, passed): kinds minimum, maximum, equal; a metric that is missing does not pass."""
    joined = thresholds.join(metrics, "metric", "left")
    v, t = F.col("value"), F.col("threshold")
    passed = F.when(F.col("kind") == "minimum", v >= t).when(F.col("kind") == "maximum", v <= t).otherwise(v == t)
    return joined.select("metric", "kind", "threshold", "value", F.coalesce(passed, F.lit(False)).alias("passed"))


def all_passed(gated: DataFrame) -> DataFrame:
    return gated.agg(F.coalesce(F.every("passed"), F.lit(True)).alias("passed"))


def reliability(examples: Column, warn_below: int = 8) -> dict[str, Column]:
    return {"per_example_swing": F.when(examples > 0, 1.0 / examples).otherwise(F.lit(0.0)), "warned": examples < warn_below}


def preference_metrics(chosen: Column, rejected: Column, beta: float = 0.1) -> dict[str, Column]:
    """Mean loss, accuracy and mean margin of log-probability pairs."""
    m = (chosen - rejected) * beta
    return {"loss": F.avg(F.log1p(F.exp(-m))), "accuracy": F.avg((m > 0).cast("double")), "margin": F.avg(m)}


def perplexity(loss: str) -> Column:
    return F.exp(F.least(F.avg(loss), F.lit(20.0)))
