"""Queries of the training-data operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.core.tables import materialise, table
from corpusmill.llm import boilerplate, encoding, forms, leakage, mixing, packing, pii, splits

CAPACITY = 4096
SHARES = {"train": 0.9, "validation": 0.05, "test": 0.05}


def _examples(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in ("sft_examples", "preference_examples")}


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, n).select("item_id", "messages") for n in ("assistant", "posttrain_regression")]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.frames(table(spark, sf_dir, "documents"), table(spark, sf_dir, "citations"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_items(spark, sf_dir), table(spark, sf_dir, "documents")).select("item_id", "doc_id")


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with their coverage, reordered passages too: three fifths of an item's words in tiles of five words or more."""
    return leakage.leaks(_items(spark, sf_dir), table(spark, sf_dir, "documents"), tile_words=5, coverage=0.6)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.mixed_groups(_examples(spark, sf_dir))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(_examples(spark, sf_dir), SHARES)


def p4_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the splits: one row, all but the first 0. No source, group, author or entity is in two splits."""
    tables = _examples(spark, sf_dir)
    placed = materialise(splits.assign_splits(tables, SHARES), "placed")
    linked = None
    for name, df in tables.items():
        linked = splits.links(df, name) if linked is None else linked.unionByName(splits.links(df, name))
    torn = linked.where("value is not null").join(placed, ["record_table", "example_id"]).groupBy("kind", "value").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("values_in_two_splits"))
    largest = F.max("n")
    sizes = placed.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).agg(largest.alias("largest"))
    by_split = placed.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    shares = spark.createDataFrame(list(SHARES.items()), "split string, share double")
    off = shares.join(by_split, "split", "left").crossJoin(placed.agg(F.count(F.lit(1)).alias("all"))).crossJoin(sizes)  # one row each
    off = off.agg(F.count_if(F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.col("all")) > 1 + F.col("largest")).alias("quotas_missed"))
    counted = placed.agg(F.count(F.lit(1)).alias("records"), (F.count(F.lit(1)) - F.count_distinct("record_table", "example_id")).alias("twice"))
    return counted.crossJoin(torn).crossJoin(off)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "data_sources"))


def p5_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scrub(table(spark, sf_dir, "documents"), table(spark, sf_dir, "data_sources"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sizes in tokens of the public tokenizer; quality is the share of prose by the line model of problem 9, at least a quarter."""
    docs = table(spark, sf_dir, "documents")
    sizes = encoding.token_counts(docs).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    prose = forms.prose_shares(docs, table(spark, sf_dir, "form_labels")).groupBy("doc_id").agg(F.max("prose_share").alias("prose_share"))
    joined = docs.select("doc_id", "source").join(sizes, "doc_id", "left").join(prose, "doc_id", "left")
    return mixing.mix(joined, table(spark, sf_dir, "data_sources"), F.coalesce("n_tokens", F.lit(0)), F.greatest(F.lit(0.25), F.coalesce("prose_share", F.lit(0.25))))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mix: one row, all but the first 0."""
    mixed, report = _mix(spark, sf_dir)
    limits = report.select("source", "weight").join(table(spark, sf_dir, "data_sources").groupBy(F.col("name").alias("source")).agg(F.max("max_records").alias("most")), "source", "left")
    per = mixed.groupBy("source").agg(F.count_distinct("doc_id").alias("docs"), F.max("copies").alias("copies"), F.min("copies").alias("fewest"))
    joined = limits.join(per, "source", "left")
    sums = report.agg(F.sum("actual_share").alias("shares"))
    counted = joined.agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("docs") > F.col("most")).alias("over_limit"), F.count_if(F.col("copies") > 4).alias("over_epochs"), F.count_if(F.col("copies") - F.col("fewest") > 1).alias("uneven_copies"),
        F.count_if((F.coalesce("weight", F.lit(0.0)) <= 0) & (F.coalesce("docs", F.lit(0)) > 0)).alias("unweighted_drawn"),
    )
    return counted.crossJoin(sums.select((F.abs(F.coalesce("shares", F.lit(1.0)) - 1) > 1e-9).cast("int").alias("shares_not_one")))  # one row each


def p6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.decode(p7_ids(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(encoding.token_counts(table(spark, sf_dir, "documents")), CAPACITY)


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: one row of counts, all but the first two 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = materialise(encoding.token_counts(docs), "tokens")
    parts = packing.pack(sizes, CAPACITY)
    fills = parts.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count_distinct("doc_id").alias("docs"))
    per_doc = parts.groupBy("doc_id").agg(F.sum("n_tokens").alias("packed"), F.count(F.lit(1)).alias("parts"))
    joined = docs.join(sizes, "doc_id", "left").join(per_doc, "doc_id", "left")
    counted = joined.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) > 0).alias("with_text"), F.count_if(F.col("packed").isNull() | (F.col("packed") != F.col("n_tokens"))).alias("not_whole"),
        F.count_if((F.col("n_tokens") <= CAPACITY) & (F.col("parts") > 1)).alias("split_but_fit"), F.count_if((F.coalesce(F.length("text"), F.lit(0)) > 0) & (F.col("packed") == 0)).alias("without_container"),
    )
    more = F.count(F.lit(1)) - F.ceil(F.sum("n") / CAPACITY)  # than the fewest that could hold all tokens
    return counted.crossJoin(fills.agg(F.count_if(F.col("n") > CAPACITY).alias("overfull"), F.coalesce((more > 1 + 0.01 * F.count(F.lit(1))).cast("int"), F.lit(0)).alias("wasteful")))  # one row each


def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.text_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "form_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.not_prose(p9_quality(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p3_found, p3_coverage, p4_found, p4_splits, p4_invariants, p5_found, p5_scrubbed, p6_mix, p6_shares, p6_invariants, p7_ids, p7_decoded, p8_containers, p8_invariants, p9_found, p9_quality)}
