"""Corpus preparation: windows, unions, cleaning, exact deduplication, budgets, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def record_window(df: DataFrame, ord_: Column, skip: int, take: int | None) -> DataFrame:
    """Records skip .. skip+take of the order given by a contiguous ordinal from 0: a filter, no sort."""
    skip = max(skip, 0)
    out = df.where(ord_ >= skip)
    return out if take is None else out.where(ord_ < skip + max(take, 0))


def resumed_window(skip: int, take: int | None, consumed: int) -> tuple[int, int | None]:
    """The window left after `consumed` records of it."""
    return skip + consumed, None if take is None else max(take - consumed, 0)


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Sources one after the other; source_idx keeps their order."""
    tagged = [s.withColumn("source_idx", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def clean(documents: DataFrame, config: DataFrame, *, least: int = 128, most: int = 200_000) -> DataFrame:
    """Adds clean_text and dropped_reason (null: kept so far) by each source's switches; documents of no source follow all switches.

    The configuration joins by name; Spark broadcasts it by its size.
    """
    flags = config.select(F.col("name").alias("source"), *(F.coalesce(F.col(c), F.lit(True)).alias(f"_{c}") for c in ("quality_filter", "deduplicate", "pii_scrub")))
    joined = documents.where(F.col("text").isNotNull()).join(flags.dropDuplicates(["source"]), "source", "left")
    on = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(True))
    plain = T.normalize_whitespace(F.col("text"))
    out = joined.withColumn("clean_text", plain).withColumn("clean_text", F.when(on("pii_scrub"), T.scrub(F.col("clean_text"))).otherwise(F.col("clean_text")))
    return out.withColumn("dropped_reason", F.when(on("quality_filter") & ~T.quality_ok(F.col("clean_text"), least, most), F.lit("quality_filter"))).withColumn("deduplicate", on("deduplicate")).drop("_quality_filter", "_deduplicate", "_pii_scrub")


def exact_dedup(documents: DataFrame, text: str, order: list[Column], among: Column | None = None) -> DataFrame:
    """Keeps the first of equal texts. Rows outside `among` neither look nor are looked at.

    A partial aggregate over hashes finds the texts that repeat and their first rows, so a text repeated
    without end costs one row a partition. Only the table of repeated texts is joined back: where it is
    short, Spark sends it to the documents and no text is shuffled.
    """
    rows = documents.withColumn("__mill_h", F.sha2(F.col(text), 256))
    looked = rows if among is None else rows.where(among)
    repeated = looked.groupBy("__mill_h").agg(F.min(F.struct(*order)).alias("__mill_first"), F.count(F.lit(1)).alias("__mill_n")).where("__mill_n > 1").drop("__mill_n")
    mine = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    kept = rows.withColumn("__mill_me", F.struct(*order)).withColumn("__mill_in", mine).join(repeated, "__mill_h", "left")
    return kept.where(~F.col("__mill_in") | F.col("__mill_first").isNull() | (F.col("__mill_me") == F.col("__mill_first"))).drop("__mill_h", "__mill_me", "__mill_in", "__mill_first")


def dedup_against(documents: DataFrame, prior: DataFrame, text: str) -> DataFrame:
    """Documents whose text no prior document has."""
    seen = prior.select(F.sha2(F.col(text), 256).alias("_h")).where("_h is not null").distinct()
    return documents.withColumn("_h", F.sha2(F.col(text), 256)).join(seen, "_h", "left_anti").drop("_h")


def running(df: DataFrame, values: list[str], ord_: str, n_ranges: int | None = None) -> DataFrame:
    """Adds before_<value>: the sum over all rows before, in the order of a unique long ordinal.

    Rows are summed in ranges of the ordinal first; one small row a range is ordered in one place, the
    rows themselves only within their range. n_ranges is four per shuffle partition by default, at least 256.
    """
    n_ranges = n_ranges or max(256, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = df.agg(F.min(ord_).alias("lo"), F.max(ord_).alias("hi")).first()
    lo, hi = (bounds.lo or 0), (bounds.hi or 0)
    width = max(1, -(-(hi - lo + 1) // n_ranges))
    ranged = df.withColumn("_range", F.least(F.floor((F.col(ord_).cast("double") - float(lo)) / width), F.lit(n_ranges)).cast("int"))
    sums = ranged.groupBy("_range").agg(*(F.sum(v).alias(f"_s_{v}") for v in values))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", *(F.coalesce(F.sum(f"_s_{v}").over(w), F.lit(0)).alias(f"_o_{v}") for v in values))
    inner = Window.partitionBy("_range").orderBy(ord_).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged
    for v in values:
        out = out.withColumn(f"_i_{v}", F.coalesce(F.sum(v).over(inner), F.lit(0)))
    out = out.join(offsets, "_range")
    for v in values:
        out = out.withColumn(f"before_{v}", F.col(f"_o_{v}") + F.col(f"_i_{v}"))
    return out.drop("_range", *(f"_o_{v}" for v in values), *(f"_i_{v}" for v in values))


def budget_prefix(df: DataFrame, budgets: dict[str, int], ord_: str) -> DataFrame:
    """The rows from the start while every budget had room before them: the row that crosses one is the last."""
    out = running(df, list(budgets), ord_)
    for v, limit in budgets.items():
        out = out.where(F.col(f"before_{v}") < limit)
    return out.drop(*(f"before_{v}" for v in budgets))


def progress(documents: DataFrame, by: str, accepted: Column) -> DataFrame:
    return documents.groupBy(by).agg(F.count(F.lit(1)).alias("consumed"), F.count_if(accepted).alias("accepted"))


def shards(df: DataFrame, ord_: str, rows_per_shard: int) -> DataFrame:
    """Adds the shard and the row within it of a contiguous ordinal."""
    return df.withColumn("shard", F.floor(F.col(ord_) / rows_per_shard).cast("long")).withColumn("row_in_shard", F.col(ord_) % rows_per_shard)


def next_fit(sizes: DataFrame, capacity: int, ord_: str = "ord", size: str = "n", lane: str = "lane") -> DataFrame:
    """(lane, ord, row, offset): the sequence rows that next-fit packing gives, in order, a lane at a time.

    A document longer than the capacity takes rows of its own, which come before the row that is open.
    Only (ord, size) pairs go through the ordered fold; one lane is the exact sequential result, more
    lanes are packed side by side.
    """
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ord_)
        out, row, open_row, used = [], 0, None, 0
        for o, n in zip(pdf[ord_], pdf[size]):
            if n <= 0:
                continue
            if n > capacity:
                for k in range(-(-n // capacity)):
                    out.append((o, row, 0, k))
                    row += 1
                continue
            if used + n > capacity:
                for i in open_items:
                    out.append((i[0], row, i[1], 0))
                row, used = row + 1, 0
                open_row = None
            if open_row is None:
                open_items, open_row = [], True
            open_items.append((o, used))
            used += n
        if open_row:
            out += [(i[0], row, i[1], 0) for i in open_items]
        table = pd.DataFrame(out, columns=[ord_, "row", "offset", "part"])
        table[lane] = pdf[lane].iloc[0] if len(pdf) else None
        return table

    schema = f"{ord_} long, row long, offset long, part long, {lane} long"
    return sizes.select(F.col(lane).cast("long").alias(lane), F.col(ord_).cast("long").alias(ord_), F.col(size).cast("long").alias(size)).groupBy(lane).applyInPandas(fold, schema)


def pad(ids: Column, length: int, pad_id: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad_id), length)), 1, length)


def masked_labels(ids: Column, pad_id: int, ignored: int = -100) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad_id, F.lit(ignored)).otherwise(x))
