"""Hashes that must equal Python's; Arrow UDFs, kept off the hot paths."""

from __future__ import annotations

import difflib
import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def blake2b_hex(texts: pd.Series) -> pd.Series:
    """128-bit blake2b of a text, the document id of texts without one."""
    return texts.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=16).hexdigest())


@F.pandas_udf(StringType())
def canonical_sha256(payloads: pd.Series) -> pd.Series:
    """sha256 of JSON with sorted keys, no blanks and ASCII escapes."""

    def one(p):
        return None if p is None else hashlib.sha256(json.dumps(json.loads(p), sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()

    return payloads.map(one)


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings; the matcher of a repeated right side is kept."""
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")
