"""Incremental runs on Structured Streaming: file sources, first-wins deduplication, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.functions import text as T


def file_stream(spark: SparkSession, path: str, schema: StructType, format_: str = "parquet", files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.format(format_).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def dedup_stream(documents: DataFrame, text: str = "text", watermark: tuple[str, str] | None = None) -> DataFrame:
    """Documents whose cleaned text has not come before.

    Without a watermark (column, delay) the state keeps a hash of every text, as exact deduplication
    must; with one, a text is only looked for within the delay.
    """
    hashed = documents.where(F.col(text).isNotNull()).withColumn("text_hash", F.sha2(T.scrub(T.normalize_whitespace(F.col(text))), 256))
    if watermark is None:
        return hashed.dropDuplicates(["text_hash"])
    return hashed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["text_hash"])


def windowed_counts(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what is there now, writes Parquet, and can be run again for what comes later."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def pack_stream(sizes: DataFrame, capacity: int) -> DataFrame:
    """(lane, ord, row, offset, part) of next-fit packing on a stream of (lane, ord, n): the open row of a lane is its state.

    Within a micro-batch documents come in the order of ord. Rows are numbered as they are opened, so a
    long document's own rows may follow the number of the row that is open; the groups are those of the
    batch operator over the same order.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        row, used, opened = state.get if state.exists else (0, 0, -1)
        out = []
        whole = pd.concat(list(batches)).sort_values("ord")
        for o, n in zip(whole["ord"].tolist(), whole["n"].tolist()):
            if n <= 0:
                continue
            if n > capacity:
                parts = -(-n // capacity)
                out += [(o, row + k, 0, k) for k in range(parts)]
                row += parts
                continue
            if opened < 0 or used + n > capacity:
                opened, used, row = row, 0, row + 1
            out.append((o, opened, used, 0))
            used += n
        state.update((row, used, opened))
        pdf = pd.DataFrame(out, columns=["ord", "row", "offset", "part"])
        pdf.insert(0, "lane", key[0])
        yield pdf

    rows = sizes.select(F.col("lane").cast("long"), F.col("ord").cast("long"), F.col("n").cast("long"))
    return rows.groupBy("lane").applyInPandasWithState(step, "lane long, ord long, row long, offset long, part long", "row long, used long, opened long", "append", GroupStateTimeout.NoTimeout)
