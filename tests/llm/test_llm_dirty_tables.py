"""Every training-data query on tables with null rows, repeated rows and extra columns of clashing names."""

import glob
import os

import pytest
from conftest import SF
from corpusmill.llm import queries as llm
from pyspark.sql import functions as F

CLASHING = "rank size key range host part chunk ids mark n h bucket label split kind value node root snap k1 k2 at row score word pos lane web mask one place copies upto _h _b _r _in _before doc_ids counts found full rest type runs mails scrub _scrub group_id".split()
OWN = {f.__name__ if hasattr(f, "__name__") else n: f for n, f in llm.queries().items()}


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    """(with extra columns, with null and repeated rows as well)"""
    extra, nulls = tmp_path_factory.mktemp("extra"), tmp_path_factory.mktemp("nulls")
    for f in glob.glob(f"{SF}/*.parquet"):
        df = spark.read.parquet(f)
        name = os.path.basename(f)
        more = df.select("*", *(F.lit(7).alias(c) for c in CLASHING if c not in df.columns))
        more.coalesce(1).write.parquet(f"{extra}/{name}")
        blank = spark.createDataFrame([tuple(None for _ in df.columns)] * 2, df.schema)
        df.unionByName(blank).unionByName(df.limit(3)).coalesce(1).write.parquet(f"{nulls}/{name}")
    return str(extra), str(nulls)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", sorted(OWN))
def test_extra_columns_change_nothing(spark, dirty, name):
    assert rows(OWN[name](spark, dirty[0])) == rows(OWN[name](spark, SF))


@pytest.mark.parametrize("name", sorted(OWN))
def test_nulls_and_repeats_do_not_fail(spark, dirty, name):
    assert OWN[name](spark, dirty[1]).count() >= 0
