"""Page frames (menus, notices, sidebars, footers) against main text: host suffix arrays.

The pages of a host are laid end to end as a stream of tokens (words, digit runs, separators, line
ends). Suffixes are sorted by their first `DEPTH` tokens, then by prefix doubling by twice as many, and
so on while equal ones stand on at least two pages: equal neighbours at a depth have a common prefix of
that length, so the levels hold all substrings of DEPTH * 2**k tokens that repeat, and any longer repeat
is a run of overlapping ones. Repeats do not cross lines.

School prose repeats as well; what tells a frame is that its repeats stand on pages taken from the web
far more often than in texts that never were a web page (no url), so a substring of DEPTH tokens counts
as frame by the ratio of its page shares there. A longer repeat is frame if it begins and ends with
frame substrings and at least half of those inside it are: the text in between, which alone would pass
for prose, is covered with it. Digit runs are compared both masked (dates, years) and as they are (a
host's own address and phone).

A line is frame if frame repeats cover half of its tokens, if it breaks off in dots and a frame's
closing words, or if it is a path of frame words that ends in the page's title; in a text without a url
only if at least `least_lines` of its lines are. The rest of a page, its unique runs, is the main body.

A host with many pages is cut into parts of a bounded number of pages by a hash of the page; a part is
worked off in chunks of a bounded number of tokens. A cut host gives the counts of all its substrings,
single ones too; least numbers of pages are asked only of the sums over its parts. Copies of a page
count once. Texts without a url are not shuffled: they are searched for what the web repeats, behind a
bitmap of fixed size, and only hashes of what may be found are counted.

The frame repeats go to the workers where they are at most `bound`; beyond it each text is joined to the
hashes of its own that are frame, and the same search runs over these: the result is the same.

Defined cases: null and blank texts have no lines; blank lines are never reported; lines of any length
are searched; texts without a url are searched with the repeats of all hosts; repeated
record ids give each row's lines (once per distinct line number); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.core.bitmaps import bitmap, inside
from corpusmill.core.tables import materialise, ship
from corpusmill.functions.rolling import _B1, _powers, mix, order
from corpusmill.functions.wordform import DROPPED

DEPTH = 3
#: least covered share of a frame line, the same in a text without a url, and the least frame lines there
SHARES = (0.5, 0.8, 3)
_CHUNK = 2_000_000
#: bits of the filter of web repeats: 8 MB at any number of repeats
_FILTER = 26
_NL, _DIGITS = np.uint32(1), np.uint32(0x80000000)
_SKIP, _LETTER, _DIGIT, _LINE, _MARK = range(5)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[:33] = _SKIP
_CLASS[127] = _SKIP
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[10] = _LINE


#: characters that folding leaves as they are, but for their case, and the folded forms of others seen so far
_PLAIN = frozenset(c for c in map(chr, range(128)) if not DROPPED.match(c))
_FOLDED: dict[str, str] = {}


def _ascii(text: str) -> str:
    return DROPPED.sub("", unicodedata.normalize("NFKD", text)).lower().encode("ascii", "replace").decode()


def fold(text: str) -> bytes:
    """Lower-case ASCII with the same line ends; damaged UTF-8 is mended first."""
    if not text.isascii():
        if "Ã" in text or "Â" in text or "â" in text:
            try:
                text = text.encode("latin-1").decode("utf-8")
            except UnicodeError:
                pass
        odd = set(text) - _PLAIN
        if len(odd) > 32:
            text = _ascii(text)
        for c in odd if len(odd) <= 32 else ():  # the few of most texts one by one
            if c not in _FOLDED:
                _FOLDED[c] = _ascii(c)
            text = text.replace(c, _FOLDED[c])
    return text.lower().encode("ascii", "replace")


class Stream:
    """Tokens of folded texts: hash (digit runs carry the top bit), text, line number, and the span of each line that is not empty."""

    def __init__(self, texts: list[bytes]):
        blob = np.frombuffer(b"".join(b"\n" + t for t in texts) + b"\n", np.uint8)
        doc_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cls = _CLASS[blob]
        change = np.ones(len(blob) + 1, bool)
        change[1:-1] = (cls[1:] != cls[:-1]) | (cls[1:] == _LINE)
        edges = np.flatnonzero(change)
        a, e = edges[:-1], edges[1:]
        keep = cls[a] != _SKIP
        a, e = a[keep], e[keep]
        kind = cls[a]
        # bullets, closing marks and empty lines say nothing
        for _ in range(2):
            line = kind == _LINE
            near = np.zeros(len(kind), bool)
            near[1:] |= line[:-1]
            near[:-1] |= line[1:]
            keep = ~((kind == _MARK) & near)
            a, e, kind = a[keep], e[keep], kind[keep]
        dots = (kind == _MARK) & (e - a > 1) & (blob[e - 1] == ord("."))
        a = np.where(kind == _MARK, e - 1, a)  # a run of marks is told by its last
        up, down = _powers(_B1, len(blob) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(blob * up[: len(blob)], dtype=np.uint64)])
            h = mix((sums[e] - sums[a]) * down[a] + (e - a).astype(np.uint64))
        token = (h.astype(np.uint32) >> np.uint32(1)) + np.uint32(2)
        token = np.where(kind == _DIGIT, token | _DIGITS, np.minimum(token, _DIGITS - np.uint32(1)))
        token[kind == _LINE] = _NL
        first = np.searchsorted(a, doc_at)  # the line end before each text
        doc = np.repeat(np.arange(len(doc_at)), np.diff(np.append(first, len(a))))
        newline = np.cumsum(kind == _LINE)
        self.token, self.doc, self.mark, self.word, self.dots = token.astype(np.uint32), doc, kind == _MARK, kind == _LETTER, dots
        self.line = newline - newline[first][doc] + 1
        ends = np.flatnonzero(kind == _LINE)
        self.begin, self.end = ends[:-1] + 1, ends[1:]  # tokens of each line, line ends around them
        filled = self.end > self.begin
        self.begin, self.end = self.begin[filled], self.end[filled]

    def weighed(self) -> np.ndarray:
        """How many tokens of each line count: all but a date or number that opens it."""
        n = self.end - self.begin
        if not len(n):
            return n
        words = np.flatnonzero(self.word)
        first = np.searchsorted(words, self.begin)
        at = np.where(first < len(words), words[np.minimum(first, len(words) - 1)], self.end) if len(words) else self.end
        return np.where(at < self.end, self.end - np.maximum(at, self.begin), n)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and line index of all substrings of DEPTH tokens within a line, its line ends included."""
        n = np.maximum(self.end - self.begin + 2 - DEPTH + 1, 0)
        line = np.repeat(np.arange(len(n)), n)
        at = np.repeat(self.begin - 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        said = np.zeros(len(at), bool)  # digits and marks alone are masked to the same few substrings everywhere
        for k in range(DEPTH):
            said |= self.word[at + k] | (self.token[at + k] >= _DIGITS)
        return at[said], line[said]


def _families(s: Stream, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
    """Which suffixes are compared, how deep: (tokens, indices into at, depth, salt).

    All that begin with a word in their depth, digits masked; those with digits as they are; pairs of a
    word and a separator.
    """
    masked = np.where(s.token >= _DIGITS, _DIGITS, s.token)
    digits, worded = np.zeros(len(at), bool), np.zeros(len(at), bool)
    for k in range(DEPTH):
        digits |= s.token[at + k] >= _DIGITS
        worded |= s.word[at + k]
    pairs = (s.mark[at] & s.word[at + 1]) | (s.word[at] & s.mark[at + 1])
    return [(masked, np.flatnonzero(worded), DEPTH, 1), (s.token, np.flatnonzero(digits), DEPTH, 2), (masked, np.flatnonzero(pairs), 2, 3)]


def _hash(token: np.ndarray, at: np.ndarray, depth: int, salt: int) -> np.ndarray:
    """Hash of the first `depth` tokens of suffixes."""
    with np.errstate(over="ignore"):
        out = np.full(len(at), np.uint64(salt))
        for k in range(depth):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + token[at + k].astype(np.uint64))
    return out


def _groups(h: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes sorted by the hash of a prefix: their order, where each group of equal prefixes begins, and on how many pages it stands."""
    at = order(h)  # stream order within a group
    if not len(at):
        return at, np.zeros(0, np.int64), np.zeros(0, np.int64)
    hs, pages = h[at], page[at]
    new = np.ones(len(h), bool)
    new[1:] = hs[1:] != hs[:-1]
    fresh = new.copy()
    fresh[1:] |= pages[1:] != pages[:-1]
    first = np.flatnonzero(new)
    return at, first, np.add.reduceat(fresh.astype(np.int64), first)


def _double(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a prefix of twice the length from the hashes of its halves."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + b + np.uint64(1))


def _page_counts(s: Stream, least: int, least_exact: float) -> dict[str, np.ndarray]:
    """Columns h, pages, exact (digits count), first, last of the substrings on at least `least` pages, `least_exact` where digits count.

    first and last are the hashes of the first and last DEPTH tokens of longer repeats (0 for those of DEPTH tokens).
    """
    at, line = s.windows()
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("h", "pages", "exact", "first", "last")}

    def add(h, n, exact=False, first=None, last=None) -> None:
        none = np.zeros(len(h), np.uint64)
        for k, v in zip(out, (h, n, np.full(len(h), exact), none if first is None else first, none if last is None else last)):
            out[k].append(v)

    base = np.zeros(len(s.token), np.uint64)
    for token, of, depth, salt in _families(s, at) if len(at) else ():
        own = at[of]
        h = _hash(token, own, depth, salt)
        by, first, n = _groups(h, s.doc[own + 1])
        keep = n >= (least_exact if salt == 2 else least)
        add(h[by[first[keep]]], n[keep], salt == 2)
        if salt == 1:
            base[own] = h
            kept = np.repeat(keep, np.diff(np.append(first, len(own))))
            level, ends = np.sort(own[by[kept]]), np.zeros(len(s.token), np.int64)
            ends[own] = s.end[line[of]]
    h, depth = base.copy(), DEPTH
    while len(at) and len(level):
        here = np.zeros(len(s.token), bool)
        here[level] = True
        level = level[level + 2 * depth - 1 <= ends[level]]
        level = level[here[level + depth] & (base[level + 2 * depth - DEPTH] > 0)]
        longer = _double(h[level], h[level + depth])
        by, first, n = _groups(longer, s.doc[level + 1])
        keep = n >= least
        chosen = by[first[keep]]
        add(longer[chosen], n[keep], False, base[level[chosen]], base[level[chosen] + 2 * depth - DEPTH])
        kept = np.sort(by[np.repeat(keep, np.diff(np.append(first, len(level))))])
        h[level[kept]] = longer[kept]
        level, depth = level[kept], 2 * depth
    kinds = (np.uint64, np.int64, bool, np.uint64, np.uint64)
    return {k: np.concatenate([np.zeros(0, t), *v]) for (k, v), t in zip(out.items(), kinds)}


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Chunks of (keys, folded texts): texts of a chunk are bounded in total."""
    keys, texts, size = [], [], 0
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for *key, text in zip(*columns):
            if text and not text.isspace():
                keys.append(key)
                texts.append(fold(text))
                size += len(texts[-1])
                if size >= _CHUNK * 2:
                    yield keys, texts
                    keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


_COUNTS = "host string, h long, pages long, exact boolean, first long, last long"


def _counted(least: int, exact_share: float):
    """Counts of the pages of a (host, parts, part), chunk by chunk.

    Only a host that is one chunk is held to the least numbers here, and its rows need no name; otherwise
    all counts come out, and a row without h has the number of pages.
    """

    def rows(host: str, texts: list[bytes], whole: bool) -> pa.RecordBatch:
        found = _page_counts(Stream(texts), least if whole else 1, max(least, exact_share * len(texts)) if whole else 1)
        columns = [pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in found.values()]
        if not whole:
            columns = [pa.concat_arrays([c, pa.array([x], c.type)]) for c, x in zip(columns, (None, len(texts), False, 0, 0))]
        return pa.RecordBatch.from_arrays([pa.array([None if whole else host] * len(columns[0]), pa.string()), *columns], ["host", *found])

    def of_group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, whole = key[0].as_py(), key[1].as_py() == 1
        held, size, seen = [], 0, set()
        for b in batches:
            for t in b.column("page").to_pylist():
                digest = hashlib.blake2b(t, digest_size=16).digest()
                if digest in seen:  # copies of a page are one page
                    continue
                seen.add(digest)
                if size >= _CHUNK * 2:
                    whole = False
                    yield rows(host, held, whole)
                    held, size = [], 0
                held.append(pa.decompress(t[4:], int.from_bytes(t[:4], "little"), "zstd", asbytes=True))
                size += len(held[-1])
        if held:
            yield rows(host, held, whole)

    return of_group


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole pages, folded and compressed, copies of a batch once: what a host's suffix array needs of them."""
    for b in batches:
        out: dict[tuple[str, bytes], None] = {}
        for host, t in zip(*(b.column(c).to_pylist() for c in ("host", "text"))):
            raw = b"\n".join(x for x in fold(t).split(b"\n") if x and not x.isspace())
            out[host, len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)] = None
        hosts, pages = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.binary())], ["host", "page"])


def _plain_counts(filter_, copies):
    """(h, page, n): substrings of texts without a url that may be repeats of the web, and on how many texts of a chunk they stand.

    Texts that may have copies (a bitmap of hashes of repeated texts) come with a hash of the text as page, so that copies count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _texts(batches):
            s = Stream(texts)
            at, _ = s.windows()
            digest = np.array([k[0] for k in keys], np.int64).view(np.uint64)
            page = np.where(inside(copies.value, digest), np.arange(len(texts)), -1)
            hs, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for token, of, depth, salt in _families(s, at) if len(at) else ():
                h = _hash(token, at[of], depth, salt)
                hit = inside(filter_.value, h)
                hs.append(h[hit])
                docs.append(s.doc[at[of][hit] + 1])
            h, doc = np.concatenate(hs), np.concatenate(docs)
            by = order(h)  # equal ones stand in stream order, so by text
            h, doc = h[by], doc[by]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[once], doc[once]
            single = page[doc] < 0
            kinds, n = np.unique(h[single], return_counts=True)
            pages = np.concatenate([np.zeros(len(kinds), np.int64), digest[doc[~single]].view(np.int64)])
            mask = np.arange(len(pages)) < len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([kinds, h[~single]]).view(np.int64)), pa.array(pages, mask=mask), pa.array(np.concatenate([n, np.ones(len(pages) - len(kinds), np.int64)]))], ["h", "page", "n"])

    return run


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@\s]*@)?([^/:?#\s]+)", 1))
    return F.when(found != "", found)


def frame_repeats(documents: DataFrame, *, pages_per_part: int = 2000, least_in_host: int = 2, own_share: float = 0.15, least_pages: int = 4, ratio: float = 8.0) -> DataFrame:
    """(h, web, plain): hashes of the substrings that are frame, with the numbers of pages in and out of the web.

    plain is null for repeats of more than DEPTH tokens: they follow the substrings they are made of.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.coalesce(host(F.col("url")), F.lit("")).alias("host"), "text").where(F.length(F.trim("text")) > 0)
    is_web = F.col("host") != ""
    web, plain = docs.where(is_web), docs.where(~is_web)
    # only hosts with more pages than a part holds are cut: at most a row for pages_per_part pages, and so for the
    # hosts below; a join by shuffle would bring all pages of a host to one task
    hosts = materialise(docs.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    parts = hosts.where(is_web & (F.col("n") > pages_per_part)).select("host", F.ceil(F.col("n") / pages_per_part).alias("parts"))
    pages = web.mapInArrow(_pages, "host string, page binary").join(F.broadcast(parts), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = pages.select("host", "parts", F.pmod(F.xxhash64("page"), F.col("parts")).cast("int").alias("part"), "page")
    found = materialise(placed.groupBy("host", "parts", "part").applyInArrow(_counted(least_in_host, own_share), _COUNTS), "counts")
    # hosts that are one chunk are through with the least numbers: their rows have no host and are not grouped by it
    cut = found.where("h is null").groupBy("host").agg(F.sum("pages").alias("of"))
    key = ["h", "exact", "first", "last"]
    sums = found.where("h is not null and host is not null").groupBy("host", *key).agg(F.sum("pages").alias("pages")).join(F.broadcast(cut), "host", "left")
    least = F.when(F.col("exact"), F.greatest(F.lit(float(least_in_host)), own_share * F.col("of"))).otherwise(float(least_in_host))
    enough = sums.where(F.col("pages") >= least).select("h", "first", "last", "pages").unionByName(found.where("host is null").select("h", "first", "last", "pages"))
    counts = materialise(enough.groupBy("h", "first", "last").agg(F.sum("pages").alias("web")).where(F.col("web") >= least_pages), "web")
    short = counts.where("first = 0").groupBy("h").agg(F.sum("web").alias("web"))
    shared = spark.sparkContext.broadcast(bitmap(short, "h", _FILTER))
    plain = plain.select(F.xxhash64("text").alias("digest"), "text")
    copies = spark.sparkContext.broadcast(bitmap(plain.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "digest", _FILTER))
    seen = plain.mapInArrow(_plain_counts(shared, copies), "h long, page long, n long").groupBy("h", "page").agg(F.when(F.col("page").isNull(), F.sum("n")).otherwise(F.lit(1)).alias("n"))
    seen = seen.groupBy("h").agg(F.sum("n").alias("plain"))
    n_pages = hosts.agg(F.sum(F.when(is_web, F.col("n"))).alias("w"), F.sum(F.when(~is_web, F.col("n"))).alias("p")).first()
    w, p = n_pages.w or 1, n_pages.p or 1
    base = short.join(seen, "h", "left").withColumn("plain", F.coalesce("plain", F.lit(0)))
    base = materialise(base.where(F.col("web") / w >= ratio * (F.col("plain") + 0.25) / p), "frames")
    ends = base.select("h")
    long = counts.where("first <> 0")
    for end in ("first", "last"):
        long = long.join(ends.withColumnRenamed("h", end), end, "left_semi")
    return base.unionByName(long.select("h", "web", F.lit(None).cast("long").alias("plain")))


class Frames:
    """Frame repeats ready to be searched for: exact hashes, or a bitmap of them (a superset)."""

    def __init__(self, hashes: bytes, filter_: bytes | None = None):
        self.known, self.filter = np.sort(np.frombuffer(hashes, np.uint64)), filter_
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(self.known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def _inside(self, h: np.ndarray) -> np.ndarray:
        if self.filter is not None:
            return inside(self.filter, h)
        hit = self.bloom[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]
        maybe = np.flatnonzero(hit)
        if len(maybe):
            at = np.searchsorted(self.known, h[maybe])
            hit[maybe] = self.known[np.minimum(at, len(self.known) - 1)] == h[maybe]
        return hit

    def hits(self, s: Stream) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(positions, lines, hashes, tokens) of all frame repeats found."""
        at, line = s.windows()
        out = []
        base, frame = np.zeros(len(s.token), np.uint64), np.zeros(len(s.token) + 1, np.int64)
        for token, of, depth, salt in _families(s, at) if len(at) else ():
            h = _hash(token, at[of], depth, salt)
            hit = self._inside(h)
            out.append((at[of][hit], line[of][hit], h[hit], depth))
            if salt == 1:
                base[at[of]] = h
                frame[at[of][hit] + 1] = 1
                level, lines = at[of][hit], line[of][hit]
        total, depth = np.cumsum(frame), DEPTH
        while len(at) and len(level):
            # longer repeats begin and end with frame substrings and have half of frame substrings
            depth *= 2
            ok = level + depth - 1 <= s.end[lines]
            level, lines = level[ok], lines[ok]
            closed = frame[level + depth - DEPTH + 1] > 0
            closed &= 2 * (total[level + depth - DEPTH + 1] - total[level]) >= depth - DEPTH + 1
            some, own = level[closed], lines[closed]
            if self.filter is None:  # where all is covered there is nothing to be found
                gap = total[some + depth - DEPTH + 1] - total[some] < depth - DEPTH + 1
                some, own = some[gap], own[gap]
            h = self._long(base, some, depth)
            hit = self._inside(h)
            out.append((some[hit], own[hit], h[hit], depth))
        return out

    def _long(self, base: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        return base[at] if depth == DEPTH else _double(self._long(base, at, depth // 2), self._long(base, at + depth // 2, depth // 2))

    def covered(self, s: Stream) -> np.ndarray:
        """How many tokens of each line frame repeats cover; all of a teaser cut short and of a path."""
        step = np.zeros(len(s.token) + 1, np.int64)
        found = self.hits(s)
        for at, line, _, depth in found:
            np.add.at(step, np.maximum(at, s.begin[line]), 1)
            np.add.at(step, np.minimum(at + depth, s.end[line]), -1)
        total = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
        size = s.end - s.begin
        out = total[s.end] - total[s.begin]
        for at, line, _, depth in found[:2]:
            # a teaser cut short: dots, then a frame's closing words up to the line's end
            teaser = line[s.dots[at] & (at + depth >= s.end[line] - 1)]
            out[teaser] = size[teaser]
        # a path of frame words, the page's own title last: all is covered up to the last of two separators or more
        marks = np.flatnonzero(s.mark)
        of = np.searchsorted(s.begin, marks, "right") - 1
        in_line = (of >= 0) & (marks < s.end[np.maximum(of, 0)]) if len(s.begin) else np.zeros(len(marks), bool)
        marks, of = marks[in_line], of[in_line]
        last = s.begin - 1
        np.maximum.at(last, of, marks)
        path = (np.bincount(of, minlength=len(s.begin)) >= 2) & (total[last + 1] - total[s.begin] == last + 1 - s.begin)
        out[path] = size[path]
        return out

    def lines(self, s: Stream, webs: np.ndarray, share: float, plain_share: float, least_lines: int) -> np.ndarray:
        """Indices of the frame lines among the stream's lines."""
        covered = self.covered(s)
        doc = s.doc[s.begin]
        keep = np.flatnonzero((covered > 0) & (covered >= np.where(webs[doc], share, plain_share) * s.weighed()))
        enough = np.bincount(doc[keep], minlength=len(webs)) >= np.where(webs, 1, least_lines)
        return keep[enough[doc[keep]]]


_FOUND = "record_table string, record_id long, line_no int"


def _lines(shared, share: float, plain_share: float, least_lines: int):
    """The frame lines of texts; the repeats are shared, or (shared is None) come with each text as its own hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = shared and Frames(shared.value)
        for keys, texts in _texts(batches):
            s = Stream(texts)
            own = frames or Frames(np.array(sorted({h for *_, hashes in keys for h in hashes or ()}), np.int64).tobytes())
            keep = own.lines(s, np.array([k[2] for k in keys], bool), share, plain_share, least_lines)
            kinds, ids = zip(*(keys[d][:2] for d in s.doc[s.begin[keep]])) if len(keep) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(ids, pa.int64()), pa.array(s.line[s.begin[keep]].astype(np.int32))], ["record_table", "record_id", "line_no"])

    return run


def _candidates(filter_):
    """(row, h): the hashes of each text that may be frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames(b"", filter_.value)
        for keys, texts in _texts(batches):
            s = Stream(texts)
            row = np.array([k[0] for k in keys], np.int64)
            for at, line, h, _ in frames.hits(s):
                both = np.unique(np.stack([row[s.doc[s.begin[line]]], h.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["row", "h"])

    return run


def frame_lines(texts: DataFrame, repeats: DataFrame, *, share: float = SHARES[0], plain_share: float = SHARES[1], least_lines: int = SHARES[2], bound: int = 4_000_000) -> DataFrame:
    """(record_table, record_id, line_no) of the frame lines in texts (record_table, record_id, web, text).

    Where web is false, plain_share of a line must be covered, and a text with fewer than least_lines
    frame lines has none.
    """
    spark = texts.sparkSession
    ship(spark)
    repeats = materialise(repeats.select("h"), "repeats")
    texts = texts.select("record_table", "record_id", "web", "text")
    if repeats.count() <= bound:
        shared = spark.sparkContext.broadcast(repeats.toPandas()["h"].to_numpy(np.int64).tobytes())
        return texts.mapInArrow(_lines(shared, share, plain_share, least_lines), _FOUND)
    filter_ = spark.sparkContext.broadcast(bitmap(repeats, "h", _FILTER))
    texts = texts.withColumn("row", F.xxhash64("text"))  # equal texts have equal hashes
    maybe = texts.select("row", "text").mapInArrow(_candidates(filter_), "row long, h long").distinct()
    own = maybe.join(repeats, "h").groupBy("row").agg(F.collect_list("h").alias("hashes"))  # at most the tokens of a text, seven times
    joined = texts.join(own, "row").select("record_table", "record_id", "web", "hashes", "text")
    return joined.mapInArrow(_lines(None, share, plain_share, least_lines), _FOUND)


def frames(documents: DataFrame, citations: DataFrame) -> DataFrame:
    """Frame lines of documents and of citation snippets."""
    repeats = frame_repeats(documents)
    texts = documents.select(F.lit("documents").alias("record_table"), F.col("doc_id").cast("long").alias("record_id"), host(F.col("url")).isNotNull().alias("web"), "text")
    snippets = citations.groupBy("citation_id").agg(F.max("snippet").alias("text")).select(F.lit("citations").alias("record_table"), F.col("citation_id").cast("long").alias("record_id"), F.lit(True).alias("web"), "text")
    return frame_lines(texts.unionByName(snippets), repeats)
