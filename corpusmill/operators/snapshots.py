"""A snapshot store on Parquet: keyed upserts, publishing, carrying forward, differences of two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: list[str], order: list[Column], *, first_position: str | None = None) -> DataFrame:
    """One row per key (nulls equal): the last in `order`. With first_position, that column keeps its smallest value.

    A partial aggregate picks the row, so a key delivered over and over is one row a partition before
    the shuffle.
    """
    others = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"), *([F.min(first_position).alias("_pos")] if first_position else []))
    columns = [F.col(k) for k in key] + [(F.col("_pos") if c == first_position else F.col(f"_row.{c}")).alias(c) for c in others]
    return picked.select(*columns)


def keep_best(rows: DataFrame, key: list[str], quality: list[Column], ord_: str) -> DataFrame:
    """One row per key: the best by the quality values, the earliest of equals."""
    return last_wins(rows, key, [*quality, -F.col(ord_)])


def upsert(current: DataFrame, batch: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The table after a batch: rows of the batch replace those of their key, the last of the batch standing."""
    return last_wins(current.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1))), key, [F.col("_batch"), F.col(seq)]).drop("_batch")


def latest_snapshot(headers: DataFrame, completed: bool = True) -> DataFrame:
    """The row of the current snapshot, else of the newest by (created_at, id)."""
    rows = headers.where(F.col("completed")) if completed else headers
    return rows.orderBy(F.coalesce(F.col("is_current"), F.lit(False)).desc(), F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(1)


def publish(headers: DataFrame, snapshot_id: str) -> DataFrame:
    """Exactly one current, completed snapshot: only the header table changes, rows take `current` by a join."""
    me = F.col("id") == snapshot_id
    return headers.withColumn("is_current", me).withColumn("completed", F.coalesce(F.col("completed"), F.lit(False)) | me)


def carry_forward(previous: DataFrame, ids: DataFrame, snapshot_id: str, families: list[str], *, family: str = "family") -> DataFrame:
    """Rows of the families that were not refreshed, under the new snapshot; document_id by the new ids where there is one.

    ids: (old_id, new_id).
    """
    kept = previous.where(F.col(family).isin(families))
    joined = kept.join(ids, kept["document_id"] == ids["old_id"], "left")
    return joined.withColumn("document_id", F.coalesce("new_id", "document_id")).withColumn("snapshot_id", F.lit(snapshot_id)).drop("old_id", "new_id")


def diff(before: DataFrame, after: DataFrame, key: str, content: str, family: str | None = None) -> DataFrame:
    """(key, status): added, removed, changed or unchanged between two tables; a removed row keeps its old family."""
    extra = [family] if family else []
    a = before.select(key, F.col(content).alias("_a"), F.lit(True).alias("_in_a"), *(F.col(c).alias("_fa") for c in extra))
    b = after.select(key, F.col(content).alias("_b"), F.lit(True).alias("_in_b"), *(F.col(c).alias("_fb") for c in extra))
    status = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    out = a.join(b, key, "full_outer").withColumn("status", status)
    return out.select(key, "status", *(F.coalesce("_fb", "_fa").alias(family) for _ in extra))


def diff_counts(differences: DataFrame, family: str) -> DataFrame:
    return differences.groupBy(family).pivot("status", ["added", "removed", "changed", "unchanged"]).agg(F.count(F.lit(1))).na.fill(0)


def compare_versions(left: DataFrame, right: DataFrame, key: str, fields: list[str], form: "callable", limit: int = 20) -> DataFrame:
    """(key, status) of two retrieved versions, at most `limit` a status in key order; empty if either side is."""
    a = left.select(key, *(form(F.col(f)).alias(f"_a{i}") for i, f in enumerate(fields)), F.lit(1).alias("_in_a")).dropDuplicates([key])
    b = right.select(key, *(form(F.col(f)).alias(f"_b{i}") for i, f in enumerate(fields)), F.lit(1).alias("_in_b")).dropDuplicates([key])
    same = F.lit(True)
    for i in range(len(fields)):
        same = same & F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
    status = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~same, "changed")
    out = a.join(b, key, "full_outer").select(key, status.alias("status")).where("status is not null")
    if left.isEmpty() or right.isEmpty():
        out = out.limit(0)
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("status").orderBy(key))).where(F.col("_r") <= limit).drop("_r")


def quality(sections: DataFrame, snapshot: str = "snapshot_id", mode: str = "extraction_quality") -> DataFrame:
    """(snapshot, modes, citable): distinct extraction modes in order; citable if none is degraded or uncitable."""
    return sections.groupBy(snapshot).agg(F.array_join(F.sort_array(F.collect_set(mode)), ",").alias("modes"), F.coalesce(F.every(~F.col(mode).isin("degraded", "uncitable")), F.lit(False)).alias("citable"))


def first_policy(pages: DataFrame, policies: DataFrame, text: Column, key: str, default: str = "generic") -> DataFrame:
    """(key, page_type): the first policy (least ord) whose needle stands in the text. policies: (needle, page_type, ord).

    Policies are configuration of at most 10,000 rows, more is an error; they become one expression, so
    pages are neither joined nor shuffled.
    """
    rules = policies.where("trim(needle) <> ''").orderBy("ord").limit(10_001).collect()
    if len(rules) > 10_000:
        raise ValueError("more than 10,000 policies")
    t = F.lower(text)
    table = F.array(*(F.struct(F.lit(r.needle.strip().lower()).alias("needle"), F.lit(r.page_type).alias("page_type")) for r in rules)) if rules else None
    if table is None:
        return pages.select(key, F.lit(default).alias("page_type"))
    first = F.get(F.filter(table, lambda r: F.contains(t, r["needle"])), F.lit(0))
    return pages.select(key, F.coalesce(F.when(t.isNotNull(), first["page_type"]), F.lit(default)).alias("page_type"))


#: what a page address tells of the page, in the order of the tests (fixed values)
URL_TYPES = [
    (("curriculum-detail", "course-catalog"), "course"),
    (("faculty", "directory"), "faculty"),
    (("admission", "how-to-apply", "tuition"), "admissions"),
    (("student-life", "culture-and-community"), "student_life"),
    (("college-guidance",), "college_guidance"),
    (("mission", "values"), "mission_values"),
    (("museum", "unique-learning"), "museum_programs"),
    (("athletics", "athletic-teams"), "athletics"),
    (("publication",), "publication"),
]


def url_page_type(url: Column) -> Column:
    out = None
    for parts, kind in URL_TYPES:
        test = F.lit(False)
        for p in parts:
            test = test | F.contains(url, F.lit(p))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return F.coalesce(out, F.lit("generic"))
