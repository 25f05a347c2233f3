"""Best-fit packing of documents into containers of a fixed number of tokens.

Bulk-synchronous best fit. Documents are held as ranks within their size, gaps (containers with room
left) as runs of container numbers of equal room; both are tables in the shared folder. A superstep
range-sorts sizes and gaps together: a task has a range of both and sweeps it from the largest size
down, each size to its successor gap (the smallest that holds it), conflicts settled by rank, matched
gaps shrunk at once where they stay in the range. What is left of gaps and documents meets in wider
ranges in the next superstep, up to one range, whose input is bounded by the capacity. Documents that
no gap holds open as many containers as their volume asks for, and the supersteps are repeated until
none is left. Documents of one size are exchangeable, so a sweep moves ranges of ranks, and its tables
have at most a few rows for each size, whatever the number of documents; the documents themselves are
ranked within their size once and joined to the ranges in the end.

Defined cases: a text of no tokens takes no room and lies in container null; a text longer than a
container fills whole containers of its own and its remainder is packed like any other document; ties
are broken by a hash of the id, then the id; repeated ids are separate items (ranked by row).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.core.tables import materialise, ship

#: ranges of the supersteps of a round
RANGES = (8, 2, 1)
#: kinds of rows: unplaced documents (size, first rank), gaps (room, first container), placements (size, first rank, first container)
_ITEM, _GAP, _PLACED = range(3)
_STATE = "kind int, value int, start long, count long, container long"


def sweep(items: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], least: int = 0) -> tuple[list, list, list]:
    """Unplaced items, gaps and placements after a sweep of items (size, first rank, count) over gaps (room, first container, count).

    Gaps that shrink below `least` leave the range: no item of it fits them.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    for gap, first, n in sorted(gaps, reverse=True):
        room.setdefault(gap, []).append((first, n))
    order = sorted(room)
    left_over, placed, out = [], [], []
    for size, rank, left in sorted(items, key=lambda x: (-x[0], x[1])):
        while left:
            at = bisect.bisect_left(order, size)  # the successor gap
            if at == len(order):
                left_over.append((size, rank, left))
                break
            gap = order[at]
            first, n = room[gap].pop()
            # what a container has left is the better fit for the next of this size: it takes all it holds
            each = min(gap // size, left)
            m = min(n, left // each)
            if m < n:
                room[gap].append((first + m, n - m))
            if not room[gap]:
                del room[gap]
                order.pop(at)
            for _ in range(each):
                placed.append((size, rank, m, first))
                rank += m
            left -= each * m
            rest = gap - each * size
            if rest >= max(least, 1):
                if rest not in room:
                    bisect.insort(order, rest)
                    room[rest] = []
                room[rest].append((first, m))
            elif rest:
                out.append((rest, first, m))
    out += [(gap, first, n) for gap, runs in room.items() for first, n in runs]
    return left_over, out, placed


def _swept(width: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("kind", "value", "start", "count")))]
        items, gaps, placed = sweep([r[1:] for r in rows if r[0] == _ITEM], [r[1:] for r in rows if r[0] == _GAP], key[0].as_py() * width + 1)
        out = [(_ITEM, *r, None) for r in items] + [(_GAP, *r, None) for r in gaps] + [(_PLACED, *r) for r in placed]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = zip(*out) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "value", "start", "count", "container"])

    return run


def best_fit(histogram: DataFrame, capacity: int) -> DataFrame:
    """(size, lo, count, first): ranks lo .. lo+count of a size go to the containers first .. first+count, one each.

    histogram: (size, count), sizes from 1 to capacity.
    """
    spark = histogram.sparkSession
    ship(spark)
    state = materialise(histogram.select(F.lit(_ITEM).alias("kind"), F.col("size").cast("int").alias("value"), F.lit(0).cast("long").alias("start"), F.col("count").cast("long").alias("count"), F.lit(None).cast("long").alias("container")), "items")
    items, placed, opened = state, None, 0
    while True:
        # documents that no gap holds: at least their volume in containers, and one for each of more than half a container
        want = items.agg(F.coalesce(F.sum(F.col("value") * F.col("count")), F.lit(0)), F.coalesce(F.sum(F.when(F.col("value") * 2 > capacity, F.col("count"))), F.lit(0))).first()
        if not want[0]:
            break
        new = max(-(-want[0] // capacity), want[1])
        state = state.unionByName(spark.createDataFrame([(_GAP, capacity, opened, new, None)], _STATE))
        opened += new
        for ranges in RANGES:
            width = -(-capacity // ranges)
            found = materialise(state.groupBy(F.floor((F.col("value") - 1) / width).cast("int").alias("range")).applyInArrow(_swept(width), _STATE), "sweep")
            done = found.where(F.col("kind") == _PLACED)
            placed = done if placed is None else placed.unionByName(done)
            state = found.where(F.col("kind") != _PLACED)
        items = state.where(F.col("kind") == _ITEM)
    if placed is None:
        placed = state.limit(0)
    return placed.select(F.col("value").alias("size"), F.col("start").alias("lo"), "count", F.col("container").alias("first"))


def ranked(items: DataFrame, by: list[str], tie: list[str], n_buckets: int = 64) -> DataFrame:
    """Adds rank (from 0) within `by`, in the order of a hash of `tie`; a hot class is ranked in hash buckets side by side."""
    spread = items.withColumn("_h", F.xxhash64(*tie)).withColumn("_b", F.shiftrightunsigned("_h", 64 - n_buckets.bit_length() + 1).cast("int"))
    counts = spread.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *tie)) - 1
    return spread.withColumn("_r", inner).join(before, [*by, "_b"]).withColumn("rank", F.col("_before") + F.col("_r")).drop("_h", "_b", "_r", "_before")


def _in_ranges(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds lo and first of the range that holds each document's rank: ranges and ranks of a size are cut into steps of the ranks.

    A step is the mean length of a size's ranges, so that few ranges meet in one and a range spans few.
    """
    step = F.greatest(F.lit(1), F.floor(F.sum("count") / F.count(F.lit(1)))).cast("long")
    steps = plan.groupBy("size").agg(step.alias("step"))
    cut = plan.join(steps, "size").withColumn("at", F.explode(F.sequence(F.floor(F.col("lo") / F.col("step")), F.floor((F.col("lo") + F.col("count") - 1) / F.col("step")))))
    ranks = placed.join(F.broadcast(steps.withColumnRenamed("size", "rest")), "rest").withColumn("at", F.floor(F.col("rank") / F.col("step")))
    held = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("count"))
    return ranks.join(cut.select(F.col("size").alias("rest"), "at", "lo", "count", "first"), ["rest", "at"]).where(held)


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, n_tokens, container_id) for sizes (doc_id, n_tokens); part counts the pieces of a split text from 0."""
    ship(sizes.sparkSession)
    rows = materialise(sizes.select("doc_id", F.col("n_tokens").cast("long").alias("n")), "sizes")
    c = F.lit(capacity).cast("long")
    rows = rows.withColumn("full", F.when(F.col("n") > capacity, F.floor(F.col("n") / c)).otherwise(F.lit(0)).cast("long")).withColumn("rest", (F.col("n") - F.col("full") * c).cast("int"))
    # at most `capacity` rows; whatever follows of sizes and gaps is bounded by it
    histogram = rows.where("rest > 0").groupBy(F.col("rest").alias("size")).agg(F.count(F.lit(1)).alias("count"))
    plan = materialise(best_fit(histogram, capacity), "plan")
    n_small = plan.agg(F.coalesce(F.max(F.col("first") + F.col("count")), F.lit(0))).first()[0]
    placed = ranked(rows.where("rest > 0"), ["rest"], ["doc_id", "n"])
    small = _in_ranges(placed, plan).select("doc_id", F.col("full").cast("int").alias("part"), F.col("rest").cast("long").alias("n_tokens"), (F.col("first") + F.col("rank") - F.col("lo")).alias("container_id"))
    long = ranked(rows.where("full > 0").select("doc_id", "n", "full").withColumn("one", F.lit(1)), ["one"], ["doc_id", "n"], 256)
    long = long.select("doc_id", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("part"))
    # whole containers are numbered beyond the packed ones; the numbers have gaps, as texts differ in length
    base = rows.agg(F.max("full")).first()[0] or 0
    whole = long.select("doc_id", F.col("part").cast("int").alias("part"), c.alias("n_tokens"), (F.lit(n_small) + F.col("rank") * F.lit(base) + F.col("part")).alias("container_id"))
    none = rows.where("n <= 0 or n is null").select("doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("container_id"))
    return small.unionByName(whole).unionByName(none)
