"""Column expressions over texts: white space, scrubbing, quality, pages, chat. All JVM-side unless stated."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: white space as Python's str.split sees it; Java's (?U)\s lacks the four separators
WS = r"(?:[\x1c-\x1f]|(?U:\s))"
#: patterns of the scrubber, in the order of their use (fixed values)
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?U)(?:(?:\+?1[-.\s]*)?(?:\(\d{3}\)|\d{3})[-.\s]*)\d{3}[-.\s]*\d{4}"
SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
#: line ends as Python's str.splitlines sees them
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at either end."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def normalize_whitespace(text: Column) -> Column:
    """squeeze, NUL characters being white space as well."""
    return squeeze(F.translate(text, "\x00", " "))


def normalize_text(text: Column) -> Column:
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def scrub(text: Column) -> Column:
    """Addresses of e-mail, phone numbers and social security numbers as [EMAIL], [PHONE], [SSN], in this order."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, EMAIL, "[EMAIL]"), PHONE, "[PHONE]"), SSN, "[SSN]")


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}", ""))


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed part."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def quality_ok(text: Column, least: int, most: int, least_letters: float = 0.2, most_links: int = 100) -> Column:
    """Length within bounds, enough letters, not too many links; empty texts fail."""
    n = F.length(text)
    return (n >= least) & (n <= most) & (n > 0) & (letters(text) / n >= least_letters) & (occurrences(text, "http") <= most_links)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalize_text(text), F.lit("[a-z0-9]+"), 0)


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(squeeze(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def school_years(text: Column, strict: bool = False) -> Column:
    """All school years as YYYY-YY; not strict, two digits after the dash are enough (so an ISO date gives one)."""
    end = r"(\d{2})(?!\d)" if strict else r"(\d{2})"
    found = F.regexp_extract_all(text, F.lit(r"20\d{2}\s*[-–]\s*" + end), 0)
    return F.transform(found, lambda y: F.regexp_replace(y, r"\s*[-–]\s*", "-"))


def first_school_year(*texts: Column) -> Column:
    """The first school year in the first text that has one, en dash and blanks as a plain dash."""
    found = [F.regexp_extract(t, r"(20\d{2}\s*[-–]\s*\d{2})", 1) for t in texts]
    return F.translate(F.coalesce(*(F.nullif(f, F.lit("")) for f in found)), "– ", "-")


def course_codes(text: Column, ignore_case: bool = False) -> Column:
    flag = "(?i)" if ignore_case else ""
    return F.regexp_extract_all(text, F.lit(flag + r"\b([A-Z]{2,8}\s?-?\d{2,4}[A-Z]?)\b"), 1)


def cut_at(text: Column, stops: list[str]) -> Column:
    """The text up to the first of each stop, in the order of the stops, trimmed."""
    for s in stops:
        text = F.split_part(text, F.lit(s), F.lit(1))
    return squeeze_ends(text)


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def contains_any(text: Column, parts: list[str]) -> Column:
    """Whether any fixed part stands in the text (null: no)."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return F.coalesce(out, F.lit(False))


def matched_share(text: Column, parts: Column) -> Column:
    """Share of an array's strings that stand in the text, case aside; 0 for none asked."""
    n = F.size(F.coalesce(parts, F.array().cast("array<string>")))
    hits = F.size(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda p: F.contains(F.lower(text), F.lower(p))))
    return F.when(n > 0, hits / n).otherwise(F.lit(0.0))


# pages -------------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """HTML entities resolved; there is no built-in for it."""
    return texts.map(lambda t: _html.unescape(t) if t is not None and "&" in t else t)


def _plain(fragment: Column) -> Column:
    return squeeze(unescape(F.regexp_replace(fragment, "<[^>]+>", " ")))


def html_title(page: Column, untitled: str = "Untitled") -> Column:
    title = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    heading = F.regexp_extract(page, r"(?is)<h([1-3])[^>]*>(.*?)</h\1>", 2)
    has = lambda p: F.rlike(page, F.lit(p))
    return F.when(has(r"(?is)<title[^>]*>.*?</title>"), _plain(title)).when(has(r"(?is)<h([1-3])[^>]*>.*?</h\1>"), _plain(heading)).otherwise(F.lit(untitled))


def html_headings(page: Column) -> Column:
    """Texts of the headings of the first three levels, joined by line ends; empty ones left out."""
    found = F.regexp_extract_all(page, F.lit(r"(?is)<h([1-3])[^>]*>(.*?)</h\1>"), 2)
    joined = F.array_join(F.transform(found, lambda h: F.regexp_replace(F.regexp_replace(h, "<[^>]+>", " "), r"[\r\n]+", " ")), "\n")
    lines = F.transform(F.split(unescape(joined), "\n"), squeeze)
    return F.array_join(F.filter(lines, lambda h: h != ""), "\n")


def main_html(page: Column) -> Column:
    """The inside of main, else article, else body, else the page."""
    out = page
    for tag in ("body", "article", "main"):
        pattern = rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"
        out = F.when(F.rlike(page, F.lit(pattern)), F.regexp_extract(page, pattern, 1)).otherwise(out)
    return out


def html_to_text(page: Column) -> Column:
    """Scripts out, block ends as line ends, tags out, entities resolved, lines squeezed, blank ones out."""
    t = F.regexp_replace(main_html(page), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)</(p|div|section|article|li|h1|h2|h3|tr)>", "\n")
    t = unescape(F.regexp_replace(t, "<[^>]+>", " "))
    return F.array_join(F.filter(F.transform(F.split(t, LINE_END), squeeze), lambda x: x != ""), "\n")


def chunks(text: Column, size: int = 500) -> Column:
    """Paragraphs gathered greedily into chunks of at most `size` characters; a paragraph is never cut."""
    parts = F.filter(F.transform(F.split(text, "\n"), squeeze), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        longer = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n"), p))
        full = (s["open"] != "") & (F.length(longer) > size)
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"), F.when(full, p).otherwise(longer).alias("open"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


# chat --------------------------------------------------------------------------------------------

#: tokens of the chat template (fixed values)
ROLE_TOKENS = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>", "tool": "<|tool|>"}
EOS = "</s>"


def render_chat(messages: Column, generation_prompt: bool = False) -> Column:
    """Messages in the chat template; an unknown role is an error."""
    tokens = F.create_map(*(F.lit(x) for pair in ROLE_TOKENS.items() for x in pair))

    def one(m: Column) -> Column:
        token = F.try_element_at(tokens, m["role"])
        bad = F.raise_error(F.concat(F.lit("unsupported role "), F.coalesce(m["role"], F.lit("null")))).cast("string")
        return F.concat(F.coalesce(token, bad), F.lit("\n"), squeeze_ends(F.coalesce(m["content"], F.lit(""))), F.lit("\n" + EOS))

    out = F.array_join(F.transform(messages, one), "\n")
    return F.concat(out, F.lit("\n" + ROLE_TOKENS["assistant"] + "\n")) if generation_prompt else out


def as_messages(prompt: Column) -> Column:
    """A non-blank string as one user message, else null."""
    t = squeeze_ends(prompt)
    return F.when(F.length(t) > 0, F.array(F.struct(F.lit("user").alias("role"), t.alias("content"))))


def signature(messages: Column, with_assistant: bool = False) -> Column:
    """Canonical JSON of the normalised messages; without the assistant's, what was asked."""
    kept = messages if with_assistant else F.filter(messages, lambda m: F.trim(F.coalesce(m["role"], F.lit(""))) != "assistant")
    plain = F.transform(kept, lambda m: F.struct(squeeze(F.coalesce(m["content"], F.lit(""))).alias("content"), F.trim(F.coalesce(m["role"], F.lit(""))).alias("role")))
    return F.to_json(plain)


def last_user(messages: Column) -> Column:
    """The last user message's content, '' without one."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    return F.coalesce(F.try_element_at(users, F.lit(-1))["content"], F.lit(""))
