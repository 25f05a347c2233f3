"""Record sources: one dispatch over formats, config-sized JSON readers, pages from files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMATS = ("text", "jsonl", "parquet", "arrow")


class ArrowFiles(DataSource):
    """Arrow IPC files as a batch source: one partition a record batch of a file."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _paths(self) -> list[str]:
        return json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]

    def schema(self) -> StructType:
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        with pa.memory_map(self._paths()[0]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrowReader(self._paths(), schema.names)


class _Batch(InputPartition):
    def __init__(self, path: str, index: int):
        super().__init__(f"{path}#{index}")
        self.path, self.index = path, index


class _ArrowReader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str]):
        self.paths, self.names = paths, names

    def partitions(self):
        import pyarrow as pa

        out = []
        for p in self.paths:
            with pa.memory_map(p) as f:
                out += [_Batch(p, i) for i in range(pa.ipc.open_file(f).num_record_batches)]
        return out

    def read(self, partition):
        import pyarrow as pa

        with pa.memory_map(partition.path) as f:
            yield pa.ipc.open_file(f).get_batch(partition.index).select(self.names)


def read_records(spark: SparkSession, format_: str, paths: str | list[str] | None, schema: str | StructType | None = None) -> DataFrame:
    """Records of a source. text gives one row a line in the column text; an unknown format or no path is an error."""
    if not paths:
        raise ValueError("a source needs a path or a list of paths")
    paths = [paths] if isinstance(paths, str) else list(paths)
    if format_ == "text":
        return spark.read.text(paths).withColumnRenamed("value", "text")
    if format_ == "jsonl":
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.json(paths)
    if format_ == "parquet":
        return spark.read.parquet(*paths)
    if format_ == "arrow":
        spark.dataSource.register(ArrowFiles)
        return spark.read.format("arrow_ipc").option("paths", json.dumps(paths)).load()
    raise ValueError(f"unknown format {format_!r}, known: {', '.join(FORMATS)}")


def text_column(df: DataFrame, name: str = "text") -> DataFrame:
    """Rows with a text: a missing column is an empty text, a null one drops the row."""
    if name not in df.columns:
        return df.withColumn(name, F.lit(""))
    return df.where(F.col(name).isNotNull())


def entries(payload: str | Path, keys: tuple[str, ...]) -> list[dict]:
    """Objects of a config file: a list, or the list under the first of `keys`; a missing file has none."""
    path = Path(payload)
    if not path.exists():
        return []
    found = json.loads(path.read_text())
    if isinstance(found, dict):
        found = next((found[k] for k in keys if found.get(k)), [])
    if not isinstance(found, list):
        raise ValueError(f"no list of entries in {path}")
    return [x for x in found if isinstance(x, dict)]


def marked_pages(df: DataFrame, text: str = "text") -> DataFrame:
    """(.., page, page_text) of texts marked by lines '=== Page n ==='; what stands before the first mark is no page."""
    marks = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^=== Page (\d+) ===[ \t]*$"), 1)
    parts = F.split(F.col(text), r"(?m)^=== Page \d+ ===[ \t]*$")
    zipped = F.arrays_zip(F.transform(marks, lambda m: m.cast("int")).alias("page"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("page_text"))
    return df.withColumn("_p", F.explode(zipped)).select(*df.columns, F.col("_p.page").alias("page"), F.trim(F.regexp_replace(F.col("_p.page_text"), r"^\s+|\s+$", "")).alias("page_text"))


def json_objects(payload: str) -> list[str]:
    """Every object nested in a JSON text, the outer before the inner, as JSON texts."""
    out: list[str] = []

    def walk(x):
        if isinstance(x, dict):
            out.append(json.dumps(x))
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    try:
        walk(json.loads(payload))
    except (TypeError, ValueError):
        pass
    return out


def script_objects(df: DataFrame, page: str) -> DataFrame:
    """(.., object): JSON objects in the scripts of pages, nested ones too; entities in a script are resolved if it reads no other way."""
    import html
    import re

    @F.udtf(returnType="object string")
    class Walk:
        def eval(self, text: str):
            for m in re.finditer(r"(?is)<script[^>]*>(.*?)</script>", text or ""):
                body = m.group(1).strip()
                if "{" not in body and "[" not in body:
                    continue
                for x in json_objects(body) or json_objects(html.unescape(body)):
                    yield (x,)

    df.sparkSession.udtf.register("corpusmill_script_objects", Walk)
    return df.sparkSession.sql(f"SELECT p.*, o.object FROM {{pages}} p, LATERAL corpusmill_script_objects(p.{page}) o", pages=df)
