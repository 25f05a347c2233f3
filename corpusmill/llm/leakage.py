"""Test items leaking into corpus texts: greedy string tiling over Karp-Rabin seeds.

Seeds are hashes of every window of `min_words` words of an item's passages (of all its words where a
passage is shorter). One pass over whole texts hashes their windows and keeps those in a bitmap of the
seeds, of fixed size whatever their number; what is left is joined to the table of seeds. Matching runs
on one diagonal become maximal matches, and the longest unmarked matches are marked again and again
without overlap (the tiles). A pair is a case by its longest tile, or by the share of the item's words
that its tiles cover, which finds passages whose parts stand in another order.

Defined cases: null and empty texts hold nothing; items without words in their passages give no rows;
null message lists count as empty; repeated items or documents give one row per pair of ids; roles are
compared without case. Texts are never shuffled, only the windows that hit; the joins are salted, so that
a seed or a text that hits often is spread.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.core.bitmaps import bitmap, inside
from corpusmill.core.tables import materialise, ship
from corpusmill.functions.rolling import windows, words
from corpusmill.functions.wordform import ascii_fold

_CHUNK = 2_000_000  # characters folded and hashed at once
_FILTER = 25  # bits of the filter of seeds: 4 MB
_SALTS = 8


def _each(texts: list[str]) -> list[np.ndarray]:
    h, offsets = words([ascii_fold(t) for t in texts])
    return [h[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _seeds(min_words: int):
    """(h, k, item_id, passage, at, n_words): the windows of k words of each passage; passage is a hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
            for item, passage, h in zip(b.column("item_id").to_pylist(), b.column("passage").to_pylist(), _each(b.column("text").to_pylist())):
                k = min(min_words, len(h))
                w = windows(h, k) if k else h
                for column, v in zip(out, (w.view(np.int64), k, item, passage, np.arange(len(w)), len(h))):
                    column.append(v if isinstance(v, np.ndarray) else np.full(len(w), v, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["h", "k", "item_id", "passage", "at", "n_words"])

    return run


def tiles(pos: np.ndarray, at: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (text position, passage position, words) of one passage in one text from its seeds of k words."""
    order = np.lexsort((at, pos - at))
    pos, at = pos[order], at[order]
    new = np.ones(len(pos), bool)
    new[1:] = ((pos - at)[1:] != (pos - at)[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(pos))) + k - 1
    # the longest first; of equal ones the first in the text
    todo = [(-n, t, a) for n, t, a in zip(length.tolist(), pos[first].tolist(), at[first].tolist())]
    heapq.heapify(todo)
    in_text, in_passage = np.zeros(int(pos.max()) + k, bool), np.zeros(int(at.max()) + k, bool)
    out: list[tuple[int, int, int]] = []
    while todo:
        n, t, a = heapq.heappop(todo)
        n = -n
        taken = in_text[t : t + n] | in_passage[a : a + n]
        if not taken.any():
            out.append((t, a, n))
            in_text[t : t + n] = in_passage[a : a + n] = True
            continue
        # what is marked already is cut off; the rest queues again
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for x, y in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            if y - x >= k:
                heapq.heappush(todo, (x - y, t + x, a + x))
    return out


def _hits(filter_, lengths: list[int]):
    """(doc_id, text, h, k, pos): windows of texts that may be seeds; text is a hash that keeps texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        digests: list[int] = []
        texts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            hashes, offsets = words(texts)
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
            id_of, text_of = np.array(ids, np.int64), np.array(digests, np.int64)
            for k in lengths:
                w = windows(hashes, k)
                pos = np.flatnonzero(inside(filter_.value, w))
                doc = np.searchsorted(offsets, pos, "right") - 1
                whole = pos + k <= offsets[doc + 1]
                pos, doc = pos[whole], doc[whole]
                for column, v in zip(out, (id_of[doc], text_of[doc], w[pos].view(np.int64), np.full(len(pos), k), pos - offsets[doc])):
                    column.append(v)
            for x in (ids, digests, texts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["doc_id", "text", "h", "k", "pos"])

        size = 0
        for b in batches:
            for i, digest, t in zip(*(c.to_pylist() for c in b.columns)):
                if t and i is not None:
                    ids.append(i)
                    digests.append(digest)
                    texts.append(ascii_fold(t))
                    size += len(texts[-1])
                    if size >= _CHUNK:
                        yield flush()
                        size = 0
        if ids:
            yield flush()

    return run


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of each (text, passage) from its seeds."""
    for b in batches:
        rows = []
        for r in range(b.num_rows):
            seeds = b.column("seeds")[r].values
            found = tiles(seeds.field("pos").to_numpy(), seeds.field("at").to_numpy(), b.column("k")[r].as_py())
            rows.append((len(found), max(n for *_, n in found), sum(n for *_, n in found)))
        columns = zip(*rows) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("doc_id"), b.column("k"), b.column("n_words"), *(pa.array(c, pa.int64()) for c in columns)], ["item_id", "doc_id", "k", "n_words", "n_tiles", "longest", "covered"])


def passages(items: DataFrame) -> DataFrame:
    """(item_id, text): the contents of an item's messages, system messages excepted."""
    m = items.where(F.col("item_id").isNotNull()).select("item_id", F.explode("messages").alias("m"))
    return m.where((F.lower(F.trim("m.role")) != "system") | F.col("m.role").isNull()).where(F.length(F.trim("m.content")) > 0).select("item_id", F.col("m.content").alias("text"))


def leaks(items: DataFrame, documents: DataFrame, *, min_words: int = 12, tile_words: int | None = None, coverage: float | None = None) -> DataFrame:
    """(item_id, doc_id, n_tiles, longest, covered, n_words, coverage) of every pair that is a case.

    items: (item_id, messages); documents: (doc_id, text). A pair is a case if a tile has min_words words
    (or is a whole shorter passage), or, where `coverage` is given, if tiles of at least tile_words words
    (min_words by default) cover that share of the words of the passages they hit: a passage whose
    sentences are shuffled has no long tile, but short ones everywhere.
    """
    spark = documents.sparkSession
    ship(spark)
    least = min(tile_words or min_words, min_words)
    known = passages(items).select("item_id", "text", F.xxhash64("text").alias("passage")).distinct()
    seeds = materialise(known.mapInArrow(_seeds(least), "h long, k long, item_id long, passage long, at long, n_words long"), "seeds")
    lengths = sorted(r.k for r in seeds.select("k").distinct().collect())  # at most `least` numbers
    filter_ = spark.sparkContext.broadcast(bitmap(seeds, "h", _FILTER))
    docs = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text")
    hits = docs.mapInArrow(_hits(filter_, lengths), "doc_id long, text long, h long, k long, pos long")
    salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    joined = hits.withColumn("salt", F.pmod(F.hash("doc_id", "pos"), F.lit(_SALTS))).join(salted, ["h", "k", "salt"])
    # the seeds of one text and one passage: bounded by their lengths
    pairs = joined.groupBy("doc_id", "text", "item_id", "passage", "k", "n_words").agg(F.collect_set(F.struct("pos", "at")).alias("seeds"))
    marked = pairs.mapInArrow(_tiled, "item_id long, doc_id long, k long, n_words long, n_tiles long, longest long, covered long")
    out = marked.groupBy("item_id", "doc_id").agg(
        F.sum("n_tiles").alias("n_tiles"), F.max("longest").alias("longest"), F.sum("covered").alias("covered"), F.sum("n_words").alias("n_words"), F.expr("least(1D, sum(covered) / sum(n_words))").alias("coverage"),
        F.max(F.col("longest") >= F.least(F.lit(min_words), F.col("n_words"))).alias("_long"),
    )
    return out.where(F.col("_long") if coverage is None else F.col("_long") | (F.col("coverage") >= coverage)).drop("_long")
