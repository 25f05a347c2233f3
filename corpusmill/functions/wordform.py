"""Comparable forms of texts: what markup, entities, case, accents, punctuation and spacing leave."""

from __future__ import annotations

import html
import re
import unicodedata

#: combining marks and invisible characters, as ranges
_MARKS = "̀-ͯ҃-҉֑-ֽؐ-ًؚ-ٟ᪰-᫿᷀-᷿⃐-⃿︀-️︠-︯"
_HIDDEN = "\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f­؜᠎​-‏‪-‮⁠-⁯﻿￹-￻"
DROPPED = re.compile(f"[{_MARKS}{_HIDDEN}]+")
_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑­][^\S\r\n]*(?:\r\n|\r|\n)[^\S\r\n]*(?=[^\W\d_])")


def word_sequence(text: str | None) -> str:
    """The words of a text, markup taken out, joined by single blanks. None and blank give ''."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = DROPPED.sub("", unicodedata.normalize("NFKD", text))
    return " ".join(_WORD.findall(text.casefold()))


def ascii_fold(text: str) -> bytes:
    """Lower-case bytes in which every character that is no a-z or digit after folding is a separator.

    Line-end hyphens are closed first, then compatibility forms, accents and invisible characters go.
    """
    if "-" in text or not text.isascii():
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = DROPPED.sub("", unicodedata.normalize("NFKD", text))
    return text.lower().encode("ascii", "replace")
