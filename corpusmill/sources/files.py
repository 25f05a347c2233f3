"""Whole files: bytes with a decoding cascade, content hashes, JSON lines that grow, fallbacks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _decode(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    for encoding in ("utf-8", "utf-8-sig", "latin-1"):  # the last reads any bytes
        try:
            return bytes(raw).decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


@F.pandas_udf(StringType())
def decode_bytes(raw: pd.Series) -> pd.Series:
    """Bytes as UTF-8, else as Latin-1; a byte order mark stays."""
    return raw.map(_decode)


def page_files(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """(url, html) of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("url"), decode_bytes("content").alias("html"))


def fetched(urls: DataFrame, fetch: Callable[[str], bytes], url: str = "url") -> DataFrame:
    """(.., html, error): pages by a function from address to bytes, run on the executors; a failure is a row with its message.

    No fetcher is built in: what may be fetched, and how politely, is the caller's to say.
    """
    columns = urls.columns

    def run(batches):
        for pdf in batches:
            html, errors = [], []
            for u in pdf[url]:
                try:
                    html.append(_decode(fetch(u)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any failure of one page is that page's
                    html.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(html=html, error=errors)

    schema = ", ".join(f"`{n}` {t}" for n, t in urls.select(columns).dtypes) + ", html string, error string"
    return urls.mapInPandas(run, schema)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_hash(spark: SparkSession, path: str) -> str:
    """One hash of a folder: of its files' relative paths and hashes in order of the paths."""
    import hashlib

    root = path.removeprefix("file://").rstrip("/")
    rows = file_hashes(spark, path).orderBy("path").collect()  # one small row a file
    return hashlib.sha256("\n".join(f"{r.path.split(root, 1)[-1].lstrip('/')} {r.sha256}" for r in rows).encode()).hexdigest()


def append_json(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines."""
    df.write.mode("append").json(path)


def count_examples(spark: SparkSession, path: str) -> DataFrame:
    """(file, examples): lines that are not blank."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    return lines.where(F.trim("value") != "").groupBy("file").agg(F.count(F.lit(1)).alias("examples"))


def or_last_completed(sync: Callable[[], str], latest: Callable[[], str | None]) -> tuple[str, str | None]:
    """(snapshot id, error): what sync gives, else the last completed snapshot with the failure's message; without one the failure stands."""
    try:
        return sync(), None
    except Exception as e:
        found = latest()
        if found is None:
            raise
        return found, f"{type(e).__name__}: {e}"
