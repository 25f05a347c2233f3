"""Core queries on tables with null rows, repeated rows and extra columns."""

import glob
import os

import pytest
from conftest import SF
from corpusmill import registry
from pyspark.sql import functions as F

NAMES = ["p1_found", "m01_prepared_corpus", "f05_drop_reasons", "w01_exact_dedup", "w04_token_budget", "w06_group_split", "k08_upsert_last_wins", "j04_snapshot_diff", "x20_lexical_score_topk", "x24_router", "a07_lanes", "page_chunk_rows"]
CLASHING = "rank size key bucket snap k1 k2 at row quality_filter deduplicate pii_scrub before_n one _h _me _first ord split _v score q".split()


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    extra, nulls = tmp_path_factory.mktemp("extra"), tmp_path_factory.mktemp("nulls")
    for f in glob.glob(f"{SF}/*.parquet"):
        df = spark.read.parquet(f)
        name = os.path.basename(f)
        df.select("*", *(F.lit(7).alias(c) for c in CLASHING if c not in df.columns)).coalesce(1).write.parquet(f"{extra}/{name}")
        blank = spark.createDataFrame([tuple(None for _ in df.columns)] * 2, df.schema)
        df.unionByName(blank).unionByName(df.limit(3)).coalesce(1).write.parquet(f"{nulls}/{name}")
    return str(extra), str(nulls)


@pytest.mark.parametrize("name", NAMES)
def test_queries(spark, dirty, name):
    f = registry.queries()[name]
    assert sorted(map(str, f(spark, dirty[0]).collect())) == sorted(map(str, f(spark, SF).collect()))
    assert f(spark, dirty[1]).count() >= 0
