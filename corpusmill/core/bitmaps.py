"""Bitmaps of hashes: fixed-size filters that go to the workers whatever the number of hashes behind them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BUCKET = 32_768  # bits of one row of bitmap_construct_agg


def bitmap(hashes: DataFrame, column: str, bits: int) -> bytes:
    """One bit for each hash modulo 2**bits, built by an aggregate: 2**bits / 8 bytes reach the driver, however many rows there are."""
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    bucket = F.floor(at / _BUCKET).cast("int")
    rows = hashes.select(bucket.alias("bucket"), (at % _BUCKET).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg(F.col("at")).alias("bits")).toLocalIterator()
    out = bytearray(max(1, (1 << bits) // 8))
    for r in rows:
        at_byte = r["bucket"] * (_BUCKET // 8)
        piece = bytes(r["bits"])[: len(out)]
        out[at_byte : at_byte + len(piece)] = piece
    return bytes(out)


def inside(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash (uint64) is set: never false for a hash that went in."""
    table = np.frombuffer(bits, np.uint8)
    at = hashes & np.uint64(len(table) * 8 - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
