"""Encoding of a whole corpus with a public tokenizer through a table of distinct words.

Spark splits every text into the tokenizer's words, in chunks of bounded size; a chunk keeps its
texts as positions in its own list of distinct words. The lists of all chunks are reduced to one
row per distinct word, each is encoded once, and the ids come back to the chunks by position.

Defined cases: null, empty and undecodable-free texts alike come out, null and empty ones as an
empty list of ids; strings of special tokens inside a text are ordinary text; repeated documents are
repeated rows. No text is ever shuffled, only word positions and distinct words.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.core.tables import materialise, ship
from corpusmill.llm.pretoken import split

TOKENIZERS = "/opt/tokenizers"
_CHUNK_CHARS = 4_000_000
_PIECE = 1 << 16


def shipped(spark: SparkSession, path: str) -> str:
    """Sends a vocabulary file to the workers once; they open it by the name that is returned."""
    sent = spark.sparkContext.__dict__.setdefault("_corpusmill_files", set())
    if path not in sent:
        spark.sparkContext.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def load_bpe(name: str):
    """A tiktoken encoding of a rank file (base64 piece, blank, rank a line): a path, or a file sent to the workers."""
    import tiktoken

    with open(name if os.path.exists(name) else SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # the words come in split already: one word is one match
    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a chunk: ids of the documents, words of each, positions in the chunk's word list, the list."""
    held_ids: list[int] = []
    held: list[str] = []
    size = 0

    def flush() -> pa.RecordBatch:
        words, counts = split(held)
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        packed = pa.compress(codes.astype(np.uint16).tobytes() if len(words.dictionary) <= _PIECE else codes.tobytes(), "zstd", asbytes=True)
        row = [[list(held_ids)], [counts.astype(np.int32)], [packed], [len(codes)], [words.dictionary]]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.list_(pa.string())]
        held_ids.clear()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(row, kinds)], ["doc_ids", "counts", "codes", "n_codes", "words"])

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held_ids.append(i)
            held.append(t or "")
            size += len(held[-1])
            if size >= _CHUNK_CHARS:
                yield flush()
                size = 0
    if held_ids:
        yield flush()


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for b in batches:
            words = b.column(0)
            ids = [bpe._core_bpe.encode_single_piece(w.encode()) for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return run


def word_chunks(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = docs.mapInArrow(_chunks, "doc_ids array<long>, counts array<int>, codes binary, n_codes long, words array<string>")
    return materialise(chunks.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def word_table(chunks: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(word, ids): every distinct word of the corpus, encoded once."""
    words = chunks.select(F.explode("words").alias("word")).distinct()
    return words.mapInArrow(_encode_words(shipped(chunks.sparkSession, tokenizer)), "word string, ids array<int>")


def _codes(packed: bytes, n: int, n_words: int) -> np.ndarray:
    kind = np.uint16 if n_words <= _PIECE else np.int32
    return np.frombuffer(pa.decompress(packed, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _expand(lengths_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                doc_ids = b.column("doc_ids")[r].values
                counts = b.column("counts")[r].values.to_numpy()
                # the list of (position, ids) comes in any order; ids are laid end to end by position
                pos = b.column("found")[r].values.field("pos").to_numpy()
                lists = b.column("found")[r].values.field("ids")
                n_of = np.zeros(len(pos), np.int64)
                n_of[pos] = np.asarray(lists.value_lengths())
                codes = _codes(b.column("codes")[r].as_py(), b.column("n_codes")[r].as_py(), len(pos))
                sizes = n_of[codes]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                words_end = np.concatenate([[0], np.cumsum(counts)])
                cuts = ends[words_end]
                if lengths_only:
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(cuts))], ["doc_id", "n_tokens"])
                    continue
                flat = lists.flatten().to_numpy()
                begin = np.zeros(len(pos), np.int64)
                begin[pos] = np.asarray(lists.offsets)[:-1] - np.asarray(lists.offsets)[0]
                step = 2_000
                for lo in range(0, len(counts), step):
                    hi = min(lo + step, len(counts))
                    w = codes[words_end[lo] : words_end[hi]]
                    s = sizes[words_end[lo] : words_end[hi]]
                    at = np.repeat(begin[w] - (np.cumsum(s) - s), s) + np.arange(s.sum())
                    ids = pa.ListArray.from_arrays(pa.array((cuts[lo : hi + 1] - cuts[lo]).astype(np.int32)), pa.array(flat[at], pa.int32()))
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), ids], ["doc_id", "ids"])

    return run


def _placed(chunks: DataFrame, names: str, table: DataFrame, key: str, most: int = 50_000, often: int = 1_000) -> DataFrame:
    """Each chunk's list of names joined to a table by key; (chunk, found) with the place of each name in the list.

    A frequent name stands in every chunk's list. The `most` frequent of those in more than `often` chunks
    meet the lists by a broadcast, all others by a shuffle, so that no key gathers a row of every chunk.
    """
    placed = chunks.select("chunk", F.posexplode(names).alias("pos", key))
    hot = placed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often).orderBy(F.desc("n"), key).limit(most).select(key)
    if chunks.count() > often and not hot.isEmpty():
        hot = materialise(hot.join(table, key), "frequent")
        table = table.join(F.broadcast(hot.select(key)), key, "left_anti")
        rare = placed.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
        placed = rare.unionByName(placed.join(F.broadcast(hot), key))
    else:
        placed = placed.join(table, key)
    # a chunk's list is bounded by the chunk's size
    return placed.drop(key).groupBy("chunk").agg(F.collect_list(F.struct("pos", *(c for c in table.columns if c != key))).alias("found"))


def _joined(documents: DataFrame, tokenizer: str) -> DataFrame:
    ship(documents.sparkSession)
    chunks = word_chunks(documents)
    back = _placed(chunks, "words", word_table(chunks, tokenizer), "word")
    rest = chunks.drop("words").join(back, "chunk", "left")
    return rest.withColumn("found", F.coalesce("found", F.array().cast("array<struct<pos:int,ids:array<int>>>")))


def encode(documents: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids) of every document, without special tokens."""
    return _joined(documents, tokenizer).mapInArrow(_expand(False), "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens) of every document, by the same word table."""
    return _joined(documents, tokenizer).mapInArrow(_expand(True), "doc_id long, n_tokens long")


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a chunk: ids of the documents, tokens of each (null: none), places in the chunk's list of distinct ids, the list."""
    for b in batches:
        for lo in range(0, b.num_rows, 4_000):
            docs, lists = (c.slice(lo, 4_000) for c in b.columns)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            kinds, codes = np.unique(flat, return_inverse=True)
            counts = lists.value_lengths()
            row = [[docs], [counts], [pa.compress(codes.astype(np.int32).tobytes(), "zstd", asbytes=True)], [len(codes)], [kinds]]
            types = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(row, types)], ["doc_ids", "counts", "codes", "n_codes", "kinds"])


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            found, n_kinds = b.column("found")[r].values, len(b.column("kinds")[r].values)
            if len(found) != n_kinds:
                raise ValueError("an id is not in the vocabulary")
            pieces = pa.array(found.field("piece").to_pylist(), pa.binary()).take(pa.array(np.argsort(found.field("pos").to_numpy(), kind="stable")))
            n = b.column("n_codes")[r].as_py()
            codes = np.frombuffer(pa.decompress(b.column("codes")[r].as_py(), 4 * n, "zstd", asbytes=True), np.int32) if n else np.zeros(0, np.int32)
            laid = pieces.take(pa.array(codes))  # one buffer: the pieces of all texts end to end
            ends = np.frombuffer(laid.buffers()[1], np.int32)[: len(laid) + 1] if len(laid) else np.zeros(1, np.int32)
            data = laid.buffers()[2].to_pybytes() if len(laid) else b""
            counts = b.column("counts")[r].values
            cuts = ends[np.concatenate([[0], np.cumsum(counts.fill_null(0).to_numpy())])]
            texts = [data[x:y].decode() if ok else None for x, y, ok in zip(cuts[:-1], cuts[1:], counts.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_ids")[r].values, pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, text): the distinct ids of each chunk joined to the pieces of the vocabulary file, put together by position.

    Null ids give a null text; an unknown id is an error.
    """
    spark = encoded.sparkSession
    ship(spark)
    with open(tokenizer, "rb") as f:
        pieces = [(int(r), base64.b64decode(p)) for p, r in map(bytes.split, f)]
    vocabulary = spark.createDataFrame(pieces, "id long, piece binary")
    chunks = encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(_id_chunks, "doc_ids array<long>, counts array<int>, codes binary, n_codes long, kinds array<long>")
    chunks = materialise(chunks.withColumn("chunk", F.monotonically_increasing_id()), "id_chunks")
    back = _placed(chunks, "kinds", vocabulary, "id")
    rest = chunks.join(back, "chunk", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<pos:int,piece:binary>>")))
    return rest.drop("chunk").mapInArrow(_texts_of, "doc_id long, text string")
