"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key -ln(u) / quality, u from a hash of its id: the order of the keys
within a source is a weighted sample without replacement of every size at once. A source's budget is
its share of the total; whole epochs (every document of the pool once) come first, then the documents
of the smallest keys up to the rest of the budget, by a running sum of sizes. A source larger than a
task is summed in ranges of the key: ranges are totalled first, only a range is ordered in one task.

Defined cases: null and blank sources, sources that are not configured, and sources with a null, zero
or negative weight contribute nothing (share 0); a null max_records is no limit; null and empty texts
have size 0 and are never drawn; repeated ids are separate documents; a source configured twice counts
once (its largest weight). The report has one row per configured source, those without documents too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.core.tables import materialise, ship

_RANGES = 4096


def keyed(documents: DataFrame, size: Column, quality: Column, seed: int) -> DataFrame:
    """(doc_id, source, size, key, range): the exponential key, and its place on the unit interval in ranges."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(1)) / F.lit(float(1 << 53))
    rows = documents.select("doc_id", "source", size.cast("long").alias("size"), (-F.log(F.least(u, F.lit(1.0))) / quality).alias("key"))
    return rows.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * _RANGES).cast("int"))


def _running(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the running sum of value within `by` in key order, summed in ranges of the key."""
    sums = rows.groupBy(*by, "range").agg(F.sum(value).alias("_s"))
    before = sums.select(*by, "range", (F.sum("_s").over(Window.partitionBy(*by).orderBy("range")) - F.col("_s")).alias("_before"))
    w = Window.partitionBy(*by, "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_in", F.sum(value).over(w)).join(before, [*by, "range"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_in", "_before")


def budgets(pools: list[tuple[str, float, int]], total: int, max_epochs: int) -> dict[str, tuple[float, int]]:
    """(target share, tokens to draw) of each source (name, weight, pool size).

    A source that cannot give its share with max_epochs repeats gives all it can; what it lacks goes to
    the others in proportion to their weights, until all is placed or every source is exhausted.
    """
    weights = {n: w for n, w, _ in pools if w and w > 0}
    room = {n: size * max_epochs for n, _, size in pools}
    whole = sum(weights.values()) or 1.0
    drawn = dict.fromkeys(room, 0)
    open_, left = {n for n in weights if room[n] > 0}, float(total)
    while open_:
        w = sum(weights[n] for n in open_)
        full = {n for n in open_ if left * weights[n] / w >= room[n]}
        if not full:
            for n in open_:
                drawn[n] = int(left * weights[n] / w)
            break
        for n in full:
            drawn[n] = room[n]
            left -= room[n]
        open_ -= full
    return {n: (weights.get(n, 0.0) / whole, drawn[n]) for n in room}


def mix(documents: DataFrame, sources: DataFrame, size: Column, quality: Column, *, total: int | None = None, max_epochs: int = 4, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, size, copies) and the report (source, weight, target_share, pool_size, drawn_size, actual_share, epochs, even_total).

    The source table is configuration: one small row per source goes to the driver. total defaults to
    the size of all pools together; even_total is the largest total at which every source that has
    documents keeps its target share, for those who would rather have less than other shares.
    """
    config = sources.where(F.col("name").isNotNull() & (F.trim("name") != "")).groupBy("name").agg(F.max("weight").alias("weight"), F.max("max_records").alias("max_records"))
    rows = keyed(documents, size, quality, seed).where("size > 0").join(config.select(F.col("name").alias("source"), "weight", "max_records").where("weight > 0"), "source")
    rows = materialise(rows.select("doc_id", "source", "size", "key", "range", "max_records"), "keyed")
    # only sources with a bound are ranked
    bounded = _running(rows.where("max_records is not null").withColumn("one", F.lit(1).cast("long")), ["source"], "one", "place").where("place <= max_records")
    rows = materialise(rows.where("max_records is null").drop("max_records").unionByName(bounded.select("doc_id", "source", "size", "key", "range")), "pool")
    sizes = {r.source: r.s for r in rows.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    listed = [(r.name, r.weight, sizes.get(r.name, 0)) for r in config.orderBy("name").collect()]
    plan = budgets(listed, total if total is not None else sum(sizes.values()), max_epochs)
    spark = documents.sparkSession
    ship(spark)
    weighed = [(w, size_) for _, w, size_ in listed if w and w > 0 and size_]
    even_total = int(min((size_ * max_epochs * sum(x for x, _ in weighed) / w for w, size_ in weighed), default=0))
    cuts = [(n, *divmod(plan[n][1], max(size_, 1))) for n, _, size_ in listed if size_]
    table = spark.createDataFrame(cuts or [("", 0, 0)], "source string, epochs long, rest long")
    drawn = _running(rows, ["source"], "size", "upto").join(table, "source")
    drawn = drawn.withColumn("copies", (F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).cast("int")).where("copies > 0")
    mixed = materialise(drawn.select("doc_id", "source", "size", "copies"), "mix")
    got = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("drawn_size"), F.max("copies").alias("epochs"))
    report = spark.createDataFrame([(n, float(w) if w is not None else None, float(plan[n][0]), int(s)) for n, w, s in listed], "source string, weight double, target_share double, pool_size long").join(got, "source", "left")
    report = report.withColumn("drawn_size", F.coalesce("drawn_size", F.lit(0).cast("long"))).withColumn("epochs", F.coalesce("epochs", F.lit(0)))
    whole = mixed.agg(F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0))).first()[0]
    report = report.withColumn("actual_share", F.col("drawn_size") / F.lit(whole) if whole else F.lit(0.0))
    return mixed, report.withColumn("even_total", F.lit(even_total).cast("long"))
