"""A versioned store of page rows on Parquet, and the run that refreshes it.

Tables are partitioned by snapshot_id; a snapshot's rows are written under its id and become visible
when its header says that it is completed: the header is written last, so a run that fails leaves the
last snapshot as it was.
"""

from __future__ import annotations

import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import pages, snapshots
from corpusmill.sources.readers import script_objects

_HEADER = "id string, label string, created_at string, completed boolean, is_current boolean, families string"


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.removeprefix("file://").rstrip("/")

    def _folder(self, table: str) -> str:
        return f"{self.path}/{table}"

    def write(self, table: str, rows: DataFrame, snapshot_id: str) -> None:
        """The rows of a table in a snapshot; written again, they replace only this snapshot's."""
        rows.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(self._folder(table))

    def read(self, table: str, snapshot_id: str) -> DataFrame | None:
        """A table's rows in a snapshot (one partition is read), None if the table was never written."""
        if not Path(self._folder(table)).exists():
            return None
        return self.spark.read.parquet(self._folder(table)).where(F.col("snapshot_id") == snapshot_id)

    def headers(self) -> DataFrame:
        if not Path(self._folder("snapshots")).exists():
            return self.spark.createDataFrame([], _HEADER)
        rows = self.spark.read.schema(_HEADER + ", seq long").parquet(self._folder("snapshots"))
        return snapshots.last_wins(rows, ["id"], [F.col("seq")]).drop("seq")

    def _log(self, rows: DataFrame) -> None:
        rows.withColumn("seq", F.lit(time.time_ns())).coalesce(1).write.mode("append").parquet(self._folder("snapshots"))

    def create(self, label: str, created_at: str, families: list[str]) -> str:
        id_ = f"snap-{uuid.uuid4().hex[:16]}"
        self._log(self.spark.createDataFrame([(id_, label, created_at, False, False, ",".join(families))], _HEADER))
        return id_

    def publish(self, snapshot_id: str) -> None:
        """Completed and the only current one; headers are a log, one small row a snapshot and change."""
        before = self.headers()
        after = snapshots.publish(before, snapshot_id)
        known = before.select("id", F.col("is_current").alias("_current"), F.col("completed").alias("_completed"))
        changed = after.join(known, "id").where("is_current <> _current or completed <> _completed").drop("_current", "_completed")
        # read before the log is added to
        self._log(self.spark.createDataFrame(changed.select(*(f.split()[0] for f in _HEADER.split(", "))).collect(), _HEADER))

    def latest(self) -> str | None:
        row = snapshots.latest_snapshot(self.headers()).first()
        return row.id if row else None

    def diff(self, before: str, after: str) -> DataFrame:
        """(url, status, source_family) of the documents of two snapshots."""
        a, b = self.read("documents", before), self.read("documents", after)
        return snapshots.diff(a, b, "url", "content_hash", "source_family")


def sync(store: SnapshotStore, fetched: DataFrame, label: str, created_at: str, families: list[str] | None = None, chunk_size: int = 500) -> str:
    """A new snapshot of fetched pages (url, page_type, html); families not refreshed are carried over from the last one.

    Pages without html do not count. Returns the id of the published snapshot.
    """
    previous = store.latest()
    wanted = families or sorted(pages.FRESH_HOURS)
    id_ = store.create(label, created_at, wanted)
    rows = fetched.where("html is not null").where(pages.family(F.col("page_type")).isin(wanted))
    docs = pages.document_rows(rows, id_)
    objects = script_objects(rows.select("url", "html"), "html").select("url", "object")
    made = {"documents": docs, "chunks": pages.chunk_rows(docs, chunk_size), "courses": pages.course_rows(objects), "staff": pages.faculty_rows(objects)}
    made["chunks"] = made["chunks"].join(docs.select(F.col("id").alias("document_id"), "source_family"), "document_id")
    for name, table in made.items():
        store.write(name, table.drop("snapshot_id"), id_)
    old = store.read("documents", previous) if previous else None
    if old is not None:
        rest = old.where(~F.col("source_family").isin(wanted)).drop("snapshot_id")
        moved = rest.withColumn("old_id", F.col("id")).withColumn("id", pages.stable_id("document", F.lit(id_), F.col("url")))
        ids = moved.select("old_id", F.col("id").alias("new_id"))
        chunks = store.read("chunks", previous).where(~F.col("source_family").isin(wanted)).join(ids, F.col("document_id") == F.col("old_id"), "left")
        chunks = chunks.withColumn("document_id", F.coalesce("new_id", "document_id")).withColumn("id", pages.stable_id("chunk", F.col("document_id"), F.col("chunk_index"), F.col("text"))).drop("old_id", "new_id", "snapshot_id")
        # a snapshot's partition is written whole: fresh rows and those carried over
        store.write("documents", docs.drop("snapshot_id").unionByName(moved.drop("old_id")), id_)
        store.write("chunks", made["chunks"].drop("snapshot_id").unionByName(chunks), id_)
    store.publish(id_)
    return id_
