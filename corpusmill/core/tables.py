"""Reading the input tables and cutting lineage through written tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a Spark context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_corpusmill_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="corpusmill-code-")
    _WRITTEN.append(folder)
    archive = f"{folder}/corpusmill_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(archive)
    context._corpusmill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder: a folder of one machine cannot serve a cluster")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", found)
        _WRITTEN.append(found)
    return found


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df_or_paths=None) -> None:
    """Deletes the tables written so far, by the file system that each path names."""
    session = SparkSession.getActiveSession()
    while _WRITTEN:
        path = _WRITTEN.pop()
        if path.startswith("file:"):
            path = path[len("file:") :].replace("///", "/").replace("//", "/")
        if path.startswith("/"):
            shutil.rmtree(path, ignore_errors=True)
        elif session is not None:
            try:
                at = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            except Exception:  # the session may be gone at exit: the folder's owner clears it
                pass


atexit.register(release)
