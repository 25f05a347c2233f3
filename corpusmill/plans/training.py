"""Example stages: encoded and sharded SFT and preference data."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import tokens
from corpusmill.operators import corpus, examples
from corpusmill.plans.prepare import MANIFEST, content_print, decide, fingerprint, write_manifest


def encoded_sft(df: DataFrame, model: str, specials: dict[str, int], length: int, pad_id: int, id_: str = "example_id") -> DataFrame:
    """(example id, input_ids, labels): chats in the template; rows without messages go."""
    m = examples.sft_messages(F.col("messages"))
    rows = df.withColumn("_m", m).where("_m is not null").select(F.col(id_).alias("example_id"), T.render_chat(F.col("_m")).alias("_r"))
    return rows.select("example_id", tokens.encode_chat(F.col("_r"), model, specials, length, pad_id).alias("e")).select("example_id", "e.*")


def encoded_preferences(df: DataFrame, model: str, specials: dict[str, int], length: int, pad_id: int, id_: str = "example_id") -> DataFrame:
    """(example id, chosen_ids, rejected_ids): the prompt and each answer, cut and padded."""
    rows = df.where(examples.is_preference(F.col("prompt"), F.col("chosen"), F.col("rejected")))
    prompt = T.render_chat(F.col("prompt"), True)

    def one(answer: str) -> Column:
        ids = tokens.encode(F.concat(prompt, T.squeeze_ends(F.col(answer)), F.lit("\n" + T.EOS)), model, specials, True)
        return corpus.pad(ids, length, pad_id)

    return rows.select(F.col(id_).alias("example_id"), one("chosen").alias("chosen_ids"), one("rejected").alias("rejected_ids"))


def write_stage(encoded: DataFrame, kind: str, target: str, *, key: str = "example_id", rows_per_shard: int = 1024, inputs: dict | None = None, force: bool = False) -> dict:
    """Shards of encoded examples in the order of a key's hash, with a manifest; an unchanged stage is reused."""
    folder = target.removeprefix("file://")
    print_ = fingerprint({"kind": kind, "inputs": inputs or {}, "read": content_print(encoded), "key": key, "rows_per_shard": rows_per_shard})
    if decide(folder, kind, print_, force) == "reuse":
        return json.loads((Path(folder) / MANIFEST).read_text())
    rows = encoded.withColumn("_k", F.xxhash64(key)).withColumn("one", F.lit(1).cast("long"))
    spread = corpus.shards(corpus.running(rows, ["one"], "_k"), "before_one", rows_per_shard).drop("_k", "one", "row_in_shard").withColumnRenamed("before_one", "ord")
    spread.write.mode("overwrite").partitionBy("shard").parquet(target)
    written = encoded.sparkSession.read.parquet(target)
    n, n_shards = written.agg(F.count(F.lit(1)), F.countDistinct("shard")).first()
    manifest = {"version": 1, "kind": kind, "fingerprint": print_, "rows": n, "shards": n_shards, "rows_per_shard": rows_per_shard}
    write_manifest(folder, manifest)
    return manifest
