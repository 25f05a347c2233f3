"""Corpus preparation end to end, with a manifest that lets an unchanged stage be reused."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.core.tables import materialise
from corpusmill.operators import corpus

MANIFEST = "_manifest.json"  # names with an underscore are no data to Spark


def fingerprint(inputs: dict) -> str:
    """sha256 of the stage's inputs as canonical JSON."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def content_print(df: DataFrame) -> dict:
    """Names and types of the columns, the number of rows and a sum of their hashes: other content, another print."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    maps = [F.to_json(F.col(f.name)) for f in df.schema.fields if f.name not in plain]
    nulls = [F.col(c).isNull() for c in plain]
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*plain, *maps, *nulls).cast("decimal(38,0)"))).first()
    return {"schema": df.schema.simpleString(), "rows": n, "hash": str(total)}


def decide(target: str | Path, kind: str, print_: str, force: bool = False) -> str:
    """'reuse' or 'fresh' for a target folder; a different stage in the way is an error unless forced.

    An empty manifest is treated as none. Data without a manifest is an unfinished run and written anew.
    """
    path = Path(target) / MANIFEST
    if force or not path.exists() or not path.read_text().strip():
        return "fresh"
    found = json.loads(path.read_text())
    if found.get("fingerprint") != print_ or found.get("kind") != kind:
        raise ValueError(f"{target} holds another stage; force a rebuild to replace it")
    return "reuse"


def write_manifest(target: str | Path, payload: dict) -> None:
    """Written last, by a rename: its presence says that the stage is complete."""
    tmp = Path(target) / f"_tmp{MANIFEST}"
    tmp.write_text(json.dumps(payload, indent=2, sort_keys=True))
    tmp.rename(Path(target) / MANIFEST)


def cleaned(documents: DataFrame, config: DataFrame, *, least: int = 128, most: int = 200_000, order: list[Column] | None = None) -> DataFrame:
    """Documents that pass cleaning and exact deduplication, in their sources' switches.

    The clean texts are written once: what follows reads them more than once, and a filter on the reason
    would have Catalyst compute the whole chain of replacements again for each of its terms.
    """
    rows = materialise(corpus.clean(documents, config, least=least, most=most).drop("text"), "clean").where("dropped_reason is null")
    return corpus.exact_dedup(rows, "clean_text", order or [F.col("doc_id")], F.col("deduplicate"))


def prepare(documents: DataFrame, config: DataFrame, target: str, *, budget: int | None = None, rows_per_shard: int = 2048, size: Column | None = None, force: bool = False, inputs: dict | None = None) -> dict:
    """Cleans, deduplicates, cuts at the budget and writes shards; returns the manifest.

    Documents are numbered by doc_id; the budget counts `size` (characters by default).
    """
    spark = documents.sparkSession
    read = {"documents": content_print(documents), "config": content_print(config)}
    print_ = fingerprint({"inputs": inputs or {}, "read": read, "budget": budget, "rows_per_shard": rows_per_shard, "size": str(size)})
    folder = target.removeprefix("file://")
    if decide(folder, "documents", print_, force) == "reuse":
        return json.loads((Path(folder) / MANIFEST).read_text())
    rows = cleaned(documents, config).withColumn("size", (size if size is not None else F.length("clean_text")).cast("long")).withColumn("one", F.lit(1).cast("long"))
    rows = corpus.running(rows, ["size", "one"], "doc_id")
    if budget is not None:
        rows = rows.where(F.col("before_size") < budget)
    out = corpus.shards(rows.withColumnRenamed("before_one", "ord").drop("one", "before_size", "deduplicate", "dropped_reason"), "ord", rows_per_shard)
    out.write.mode("overwrite").partitionBy("shard").parquet(target)
    written = spark.read.parquet(target)
    n, total, n_shards = written.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.countDistinct("shard")).first()
    manifest = {"version": 1, "kind": "documents", "fingerprint": print_, "rows": n, "size": total, "shards": n_shards, "rows_per_shard": rows_per_shard}
    write_manifest(folder, manifest)
    return manifest


def read_prepared(spark: SparkSession, target: str, kind: str = "documents") -> DataFrame:
    """A complete stage; one without a manifest or of another kind is an error."""
    path = Path(target.removeprefix("file://")) / MANIFEST
    if not path.exists() or json.loads(path.read_text()).get("kind") != kind:
        raise ValueError(f"{target} is no complete {kind} stage")
    return spark.read.parquet(target)
