"""Vectorised word splitting of byte-level BPE: the split pattern as boundary flags over code points.

The pattern is the published one of the 50k byte-level vocabulary:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Its words cover a text completely, so they are given by their boundaries alone.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

_L, _N, _S, _O = 0, 1, 2, 3
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    first = {"L": _L, "N": _N}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], _O) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[_SPACES] = _S
    return out


def boundaries(codes: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Flags of the code points at which a word begins; doc_start holds the first position of each (non-empty) text."""
    n = len(codes)
    cls = _classes()[codes]
    begin = np.zeros(n + 1, bool)  # one beyond, so that looking ahead needs no test
    begin[n] = True
    begin[1:n] = cls[1:] != cls[:-1]
    fresh = np.zeros(n + 1, bool)
    fresh[doc_start] = True
    fresh[n] = True
    begin |= fresh
    edges = np.flatnonzero(begin)
    a, e = edges[:-1], edges[1:]
    spaces = (cls[a] == _S) & ~fresh[e]
    e = e[spaces]
    begin[e - 1] = True
    begin[e[codes[e - 1] == 0x20]] = False
    p = np.flatnonzero((codes == 0x27) & begin[:n])
    p = p[(p + 1 < n)]
    p = p[begin[p + 1] & ~fresh[p + 1] & (cls[np.minimum(p + 1, n - 1)] == _L)]
    if len(p):
        c1 = codes[p + 1]
        c2 = np.where(p + 2 < n, codes[np.minimum(p + 2, n - 1)], 0)
        c2 = np.where(fresh[np.minimum(p + 2, n)], 0, c2)
        one = np.isin(c1, [ord(x) for x in "sdmt"])
        two = ((c1 == ord("l")) & (c2 == ord("l"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("r")) & (c2 == ord("e")))
        for q, k in ((p[one], 2), (p[two], 3)):
            begin[q + 1] = False
            begin[q + k] = True
    return begin[:n]


def split(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in order as a dictionary array, and how many words each text has."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts)
    raw = joined.encode("utf-8", "surrogatepass")
    if len(raw) == len(joined):
        codes, at = np.frombuffer(raw, np.uint8).astype(np.int32), None
    else:
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.int32)
        at = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if not len(codes):
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(boundaries(codes, starts[lengths > 0]))
    counts = np.searchsorted(first, ends) - np.searchsorted(first, starts)
    offsets = np.append(first, len(codes)) if at is None else at[np.append(first, len(codes))]
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw))
    return words.dictionary_encode(), counts
