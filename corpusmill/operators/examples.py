"""Training examples: shapes, ids, signatures, overlap guards, grouped splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def sft_messages(messages: Column, prompt: Column | None = None, response: Column | None = None) -> Column:
    """The messages, else prompt and response as two, else null (such rows are dropped)."""
    out = F.when(F.size(messages) > 0, messages)
    if prompt is not None:
        both = F.concat(T.as_messages(prompt), F.array(F.struct(F.lit("assistant").alias("role"), response.alias("content"))))
        out = F.coalesce(out, F.when(response.isNotNull(), both))
    return out


def is_preference(prompt: Column, chosen: Column, rejected: Column) -> Column:
    return F.coalesce((F.size(prompt) > 0) & chosen.isNotNull() & rejected.isNotNull(), F.lit(False))


def optional(value: Column) -> Column:
    """Squeezed text, null where nothing is left."""
    return F.nullif(T.squeeze(value), F.lit(""))


def example_id(candidates: list[Column], source: Column, messages: Column) -> Column:
    """The first candidate with text in it, else a hash of the source and all messages."""
    return F.coalesce(*(optional(c) for c in candidates), F.sha2(F.concat(F.coalesce(source, F.lit("")), F.lit("\x00"), T.signature(messages, True)), 256))


def group_id(candidates: list[Column], source: Column, messages: Column) -> Column:
    """The first candidate with text in it, else a hash of the source and what was asked."""
    return F.coalesce(*(optional(c) for c in candidates), F.sha2(F.concat(F.coalesce(source, F.lit("")), F.lit("\x00"), T.signature(messages)), 256))


def overlap(train: DataFrame, held_out: DataFrame, messages: str = "messages") -> DataFrame:
    """Rows of `train` that ask what a held-out item asks."""
    asked = held_out.select(T.signature(F.col(messages)).alias("_s")).where("_s is not null and _s <> '[]'").distinct()
    return train.withColumn("_s", T.signature(F.col(messages))).join(asked, "_s", "left_semi").drop("_s")


def group_split(examples: DataFrame, group: str, fraction: float, *, least: int = 1, seed: str = "0", stage: str = "sft") -> DataFrame:
    """Adds split ('train' or 'validation'): whole groups, in the order of a hash, until the wanted number is reached.

    At least one group stays for training. The wanted number is rounded half to even. Groups are summed
    in ranges of their hash, so neither groups nor examples are ordered in one place.
    """
    groups = examples.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), F.lit(stage), F.col(group)), 256))
    groups = groups.withColumn("_range", F.substring("_h", 1, 2))
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("g"), F.max("_h").alias("last")).first()
    wanted = max(least, round(total.n * fraction)) if fraction > 0 else 0
    sums = groups.groupBy("_range").agg(F.sum("_n").alias("_s"))
    before = sums.select("_range", (F.sum("_s").over(Window.orderBy("_range")) - F.col("_s")).alias("_o"))
    inner = F.sum("_n").over(Window.partitionBy("_range").orderBy("_h")) - F.col("_n")
    placed = groups.withColumn("_b", inner).join(before, "_range")
    taken = placed.where((F.col("_b") + F.col("_o") < wanted) & (F.col("_h") < F.lit(total.last))).select(group, F.lit(True).alias("_v"))
    joined = examples.join(taken, group, "left")
    return joined.withColumn("split", F.when(F.col("_v"), F.lit("validation")).otherwise(F.lit("train"))).drop("_v")


def range_overlaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of one identity whose half-open record windows (start, stop; null stop: open) overlap."""
    a = left.select(key, F.col("name").alias("left_name"), F.col("start").alias("l0"), F.col("stop").alias("l1"))
    b = right.select(key, F.col("name").alias("right_name"), F.col("start").alias("r0"), F.col("stop").alias("r1"))
    end = F.lit(2**62)
    return a.join(b, key).where(F.greatest("l0", "r0") < F.least(F.coalesce("l1", end), F.coalesce("r1", end))).select(key, "left_name", "right_name")
