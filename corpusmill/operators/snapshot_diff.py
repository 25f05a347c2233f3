"""What changed between consecutive full snapshots.

Records become compact (snapshot ordinal, key hash, time, content hash) arrays that are cut into
hash buckets before the only shuffle of all its records; a bucket is sorted in numpy and consecutive
snapshots are compared by searchsorted set differences. What differs is written; names and full values
are read again only for the keys that differ, by a semi-join before anything else.

Defined cases: a record twice in a snapshot counts with its latest time (null time: before all
others; equal times: the larger content hash). Null keys are a record of their own under an empty
key part. Rows of snapshots that are unknown or not completed do not count. Empty tables give no
rows. Columns beyond those named are neither read nor compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.core.tables import materialise, ship
from corpusmill.functions.wordform import word_sequence

_ENTRY = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("snap", "<i4"), ("at", "<i8"), ("row", "<i8")])
_KINDS = np.array(["added", "removed", "changed"])


@F.pandas_udf(StringType())
def words_of(texts: pd.Series) -> pd.Series:
    """Word sequence of each text; texts that repeat in a batch are folded once."""
    known: dict = {}
    return texts.map(lambda t: known[t] if t in known else known.setdefault(t, word_sequence(t)))


@F.pandas_udf(StringType())
def word_set_of(lists: pd.Series) -> pd.Series:
    """The sorted set of word sequences of a list of texts; null and empty lists are the empty set."""
    known: dict = {}

    def one(items) -> str:
        found = {known[t] if t in known else known.setdefault(t, word_sequence(t)) for t in (items if items is not None else ())}
        return "\n".join(["", *sorted(found)])

    return lists.map(one)


def completed_snapshots(headers: DataFrame) -> DataFrame:
    """(snap_key, snapshot_id, snap): completed snapshots numbered by the instant of created_at, ties by id."""
    from pyspark.sql import Window

    rows = headers.where(F.col("completed")).select(
        F.lower(F.trim("id")).alias("snap_key"), F.col("id").alias("snapshot_id"), F.expr("try_to_timestamp(created_at)").alias("_at")
    )
    rows = rows.where(F.col("_at").isNotNull() & F.col("snap_key").isNotNull()).dropDuplicates(["snap_key"])
    # one row per delivery: the header table is as long as the history, not as the data
    return rows.select("snap_key", "snapshot_id", (F.row_number().over(Window.orderBy("_at", "snap_key")) - 1).cast("int").alias("snap"))


def _latest(x: np.ndarray) -> np.ndarray:
    """One entry per (key, snapshot): the latest, sorted by key and snapshot."""
    x = x[np.lexsort((x["row"], x["at"], x["snap"], x["k2"], x["k1"]))]
    if len(x) < 2:
        return x
    last = np.ones(len(x), bool)
    last[:-1] = (x["k1"][1:] != x["k1"][:-1]) | (x["k2"][1:] != x["k2"][:-1]) | (x["snap"][1:] != x["snap"][:-1])
    return x[last]


def _bucketed(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            x = _latest(np.concatenate(held)) if held else np.zeros(0, _ENTRY)
            held.clear()
            bucket = (x["k2"].view("u8") % np.uint64(n_buckets)).astype("i4")
            order = np.argsort(bucket, kind="stable")
            ids, cuts = np.unique(bucket[order], return_index=True)
            parts = np.split(x[order], cuts[1:]) if len(ids) else []
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "entries"])

        for b in batches:
            x = np.zeros(b.num_rows, _ENTRY)
            for name in _ENTRY.names:
                x[name] = b.column(name).to_numpy(zero_copy_only=False)
            held.append(x)
            if sum(map(len, held)) >= 1_000_000:
                yield flush()
        if held:
            yield flush()

    return run


def _differences(x: np.ndarray, last_snap: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(snapshot, kinds, entries) for each consecutive pair, by searchsorted on the sorted keys."""
    out = []
    keys = np.empty(len(x), [("k1", "<i8"), ("k2", "<i8")])
    keys["k1"], keys["k2"] = x["k1"], x["k2"]
    # the entries are sorted by key, so dense ranks keep the order and compare as plain integers
    new = np.ones(len(x), bool)
    new[1:] = (keys[1:] != keys[:-1])
    rank = np.cumsum(new) - 1
    order = np.argsort(x["snap"], kind="stable")
    cuts = np.searchsorted(x["snap"][order], np.arange(last_snap + 2))
    by_snap = [order[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
    for s in range(1, last_snap + 1):
        old, now = by_snap[s - 1], by_snap[s]
        at = np.searchsorted(rank[old], rank[now])
        inside = at < len(old)
        same = np.zeros(len(now), bool)
        same[inside] = rank[old][at[inside]] == rank[now][inside]
        back = np.searchsorted(rank[now], rank[old])
        inside = back < len(now)
        kept = np.zeros(len(old), bool)
        kept[inside] = rank[now][back[inside]] == rank[old][inside]
        both, before = now[same], old[at[same]]
        out.append((s, 0, x[now[~same]]))
        out.append((s, 1, x[old[~kept]]))
        out.append((s, 2, x[both[x["row"][both] != x["row"][before]]]))
    return out


def _compare(last_snap: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, held = np.zeros(0, _ENTRY), []
        for b in batches:  # a key delivered over and over stays one entry a snapshot; merged when as much waits as is there
            held += [np.frombuffer(v.as_buffer(), _ENTRY) for v in b.column("entries")]
            if sum(map(len, held)) > max(len(x), 200_000):
                x, held = _latest(np.concatenate([x, *held])), []
        x = _latest(np.concatenate([x, *held]))
        for s, kind, rows in _differences(x, last_snap):
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["k1"]), pa.array(rows["k2"]), pa.array(np.full(len(rows), s, "i4")), pa.array(np.full(len(rows), _KINDS[kind], object), pa.string())],
                    ["k1", "k2", "snap", "change_kind"],
                )

    return run


def snapshot_changes(
    records: DataFrame,
    headers: DataFrame,
    key: Column,
    content: list[Column],
    *,
    snapshot: str = "snapshot_id",
    at: str = "ingested_at",
    values: list[str] | None = None,
    n_buckets: int | None = None,
) -> DataFrame:
    """(snapshot_id, record_key, change_kind, + old_<value> and new_<value> of each of values) between consecutive completed snapshots.

    key is the comparable key, content the comparable forms of the compared columns. n_buckets
    (default four per shuffle partition) bounds what one task sorts. An old value is that of the row that
    stands in the snapshot before, null for added records; a new one that of the later snapshot, null
    for removed records. Full rows are read only for the differing keys of their two snapshots.
    """
    ship(records.sparkSession)
    spark = records.sparkSession
    n_buckets = n_buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    snaps = completed_snapshots(headers)
    last = snaps.agg(F.max("snap")).first()[0]
    if last is None:
        last = -1
    keyed = records.withColumn("_snap_key", F.lower(F.trim(F.col(snapshot)))).withColumn("_key", F.coalesce(key, F.lit("")))
    joined = keyed.join(snaps.select(F.col("snap_key").alias("_snap_key"), F.col("snap").alias("_snap")), "_snap_key")
    hashed = lambda c: (F.xxhash64(c).alias("k1"), F.xxhash64(F.lit("second"), c).alias("k2"))
    time = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**63)))
    # nulls are skipped by xxhash64, so each compared value carries its own marker
    marked = [x for c in content for x in (c.isNull(), c)]
    compact = joined.select(*hashed(F.col("_key")), F.col("_snap").alias("snap"), time.alias("at"), F.xxhash64(*marked).alias("row"))
    bucketed = compact.mapInArrow(_bucketed(n_buckets), "bucket int, entries binary")
    found = materialise(bucketed.groupBy("bucket").applyInArrow(_compare(last), "k1 long, k2 long, snap int, change_kind string"), "changes")
    out = found.join(snaps.select("snap", "snapshot_id"), "snap")
    keys = found.select("k1", "k2").distinct()
    if not values:
        names = keyed.select(*hashed(F.col("_key")), F.col("_key").alias("record_key")).join(keys, ["k1", "k2"], "left_semi")
        names = names.groupBy("k1", "k2").agg(F.min("record_key").alias("record_key"))
        return out.join(names, ["k1", "k2"]).select("snapshot_id", "record_key", "change_kind")
    kept = joined.select(*hashed(F.col("_key")), "*").join(keys, ["k1", "k2"], "left_semi")
    stands = F.max_by(F.struct(F.col("_key").alias("key"), *values), F.struct(time, F.xxhash64(*marked)))
    rows = materialise(kept.groupBy("k1", "k2", F.col("_snap").alias("snap")).agg(stands.alias("v")), "values")
    new = rows.withColumnRenamed("v", "new")
    old = rows.select("k1", "k2", (F.col("snap") + 1).alias("snap"), F.col("v").alias("old"))
    out = out.join(new, ["k1", "k2", "snap"], "left").join(old, ["k1", "k2", "snap"], "left")
    shown = [x for v in values for x in (F.col(f"old.{v}").alias(f"old_{v}"), F.col(f"new.{v}").alias(f"new_{v}"))]
    return out.select("snapshot_id", F.coalesce("new.key", "old.key").alias("record_key"), "change_kind", *shown)


def course_key() -> Column:
    code = F.upper(F.regexp_replace(F.coalesce(F.col("code"), F.lit("")), r"[^\p{L}\p{Nd}]", ""))
    return F.concat(F.coalesce(F.col("institution_id"), F.lit("")), F.lit("/"), code)


COURSE_COLUMNS = ("snapshot_id", "institution_id", "code", "title", "description", "credits", "ingested_at")


def course_changes(courses: DataFrame, headers: DataFrame, values: list[str] | None = None) -> DataFrame:
    return snapshot_changes(courses.select(*COURSE_COLUMNS), headers, course_key(), [F.col("credits"), words_of("title"), words_of("description")], values=values)


def p1_found(courses: DataFrame, grounding: DataFrame, headers: DataFrame) -> DataFrame:
    """Changes of courses and of grounded answers between consecutive completed snapshots."""
    a = course_changes(courses, headers)
    route = F.coalesce(F.trim("route"), F.lit(""))
    b = snapshot_changes(
        grounding.select("snapshot_id", "query_key", "route", "hits", "created_at"), headers, F.col("query_key").cast("string"), [route, word_set_of(F.col("hits.title"))], at="created_at"
    )
    out = ("record_table", "snapshot_id", "record_key", "change_kind")
    return a.withColumn("record_table", F.lit("courses")).select(*out).unionByName(b.withColumn("record_table", F.lit("grounding_results")).select(*out))
