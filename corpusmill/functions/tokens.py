"""Piece tokenizers on Arrow batches: special-token-aware encoding, label masks, decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_MODELS: dict = {}


def processor(path: str):
    """The model of a path, loaded once a worker."""
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def encode_text(model, text: str, specials: dict[str, int], bos: bool = False, eos: bool = False) -> list[int]:
    """Ids of a text; strings of special tokens are their ids (the longest first), the spans between go to the model."""
    ids = [model.bos_id()] if bos and model.bos_id() >= 0 else []
    if specials:
        pattern = "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))
        for span in re.split(f"({pattern})", text):
            if span in specials:
                ids.append(specials[span])
            elif span:
                ids += model.encode(span)
    elif text:
        ids += model.encode(text)
    return ids + ([model.eos_id()] if eos and model.eos_id() >= 0 else [])


def answer_labels(ids: list[int], start: int, prefix: int, end: int) -> list[int]:
    """Labels of the spans that follow a start token (and the prefix that it opens) up to and with an end token; -100 elsewhere."""
    x = np.asarray(ids)
    labels = np.full(len(x), -100)
    at = 0
    while at < len(x):
        if x[at] != start:
            at += 1
            continue
        first = min(at + prefix, len(x))
        ends = np.flatnonzero(x[first:] == end)
        stop = first + ends[0] + 1 if len(ends) else len(x)
        labels[first:stop] = x[first:stop]
        at = max(stop, at + 1)
    return labels.tolist()


def encode(text: Column, path: str, specials: dict[str, int] | None = None, bos: bool = False, eos: bool = False) -> Column:
    @F.pandas_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = processor(path)
        for b in batches:
            yield b.map(lambda t: None if t is None else encode_text(model, t, specials or {}, bos, eos))

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The text of ids; ids beyond the model (specials) are left out."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = processor(path)
        n = model.vocab_size()
        for b in batches:
            yield b.map(lambda x: None if x is None else model.decode([int(i) for i in x if i < n]))

    return run(ids)


def encode_chat(rendered: Column, path: str, specials: dict[str, int], length: int, pad_id: int, assistant: str = "<|assistant|>", end: str = "</s>") -> Column:
    """struct(input_ids, labels) of rendered chats, cut and padded to a length; only the assistant's answers carry labels."""
    kind = StructType([StructField("input_ids", ArrayType(IntegerType())), StructField("labels", ArrayType(IntegerType()))])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = processor(path)
        prefix = len(encode_text(model, f"{assistant}\n", specials))
        for b in batches:
            rows = []
            for t in b:
                if t is None:
                    rows.append((None, None))
                    continue
                ids = encode_text(model, t, specials, bos=True)[:length]
                labels = answer_labels(ids, specials[assistant], prefix, specials[end])
                fill = length - len(ids)
                rows.append((ids + [pad_id] * fill, labels + [-100] * fill))
            yield pd.DataFrame(rows, columns=["input_ids", "labels"])

    return run(rendered)
