"""Personal information in free text: a skip-chain conditional random field over tokens.

Nodes are tokens that may belong to an item: the words and initials of runs of capitalised words, and
composite tokens (e-mail, number and address candidates, lexed as one token each because their borders
must be exact). Labels are other, begin and inside of a name, and the four other kinds. Potentials are
log-linear in features of a token (lexical score and those of its neighbours, the words around it, the
shape of a number, word lists), in the labels of neighbours by what separates them, and in the labels of
distant tokens of the same document with an equal word or a shared part of one (skip edges: a lone
surname after a title and the full name, both orders of a name, equal digits). Loopy sum-product over
all documents of a batch gives the marginals, and these alone decide; a name is a begin and what goes
on inside it, of two tokens at least.

All weights are fitted, on the corpus itself: a bounded sample of documents (`max_sample`, at most
`max_tokens` tokens each) is labelled from afar by plain rules (a word that e-mail addresses hold, a
number after the word "passport"), tokens on which the rules are not clear count only as neighbours, and
the pseudo-likelihood of the labels is climbed: each token's label given its features and its
neighbours' labels along chain and skip edges.

Lexical scores: names stand in e-mail addresses, other capitalised words do not. Every document
counts how often a word type stands in runs of capitalised words and in local parts of addresses; a
logistic model of prefixes and suffixes is fitted to at most `max_types` of the most frequent types.
The exact counts of all types go to the workers where they are at most `bound`; beyond it each text is
joined to the counts of its own types, with the same result.

Defined cases: null and empty texts hold nothing; repeated items of a document come out once; repeated
document ids give the union of their rows' items; sources that are null, unknown or without a flag are
scrubbed, a source with any false flag is not; an empty table gives no rows; a corpus that teaches
nothing (no addresses, too few documents) leaves all weights of names at zero, and no name is found.
"""

from __future__ import annotations

import bisect
import re
import string
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.core.tables import materialise, ship

LABELS = ("other", "name", "name", "email", "phone", "idnum", "address")
_O, _B, _I, _EMAIL, _PHONE, _ID, _ADDRESS = range(7)
_K = len(LABELS)

#: letters after a capital: accents may be separate, or stand as damaged bytes
_L = r"[^\W\d_]|[̀-ͯ\u0080-¿]"
_UP = r"[A-ZÀ-ÖØ-Þ]"
_W = rf"(?:{_L})"
#: what follows a capital; plain letters first, as one row, since nothing that follows a word begins with one
_TAIL = rf"[a-z]*+(?:{_L}|['’](?!s\b)(?=[^\W\d_]))*"
_WORD = rf"{_UP}{_TAIL}"
_NAMEWORD = rf"{_WORD}(?:-{_WORD})*"
_GAP = r"(?:[  ]|, ?|\n|\r\n)"
#: the lookbehind stands after the first character: so the search can skip to capitals
RUN = re.compile(rf"{_UP}(?<![\w@.+'’-]{_UP})(?:\.|{_TAIL}(?:-{_WORD})*(?!\w))(?:{_GAP}(?:{_UP}\.|{_NAMEWORD}(?![\w@])))+")
PART = re.compile(rf"{_UP}\.(?!\w)|{_NAMEWORD}")
LOWER_RUN = re.compile(r"(?<![\w@.+-])[^\W\d_][^\W\d_'’-]*(?:-[^\W\d_]+)*(?:(?: |, )(?:[^\W\d_]\.|[^\W\d_][^\W\d_'’-]*(?:-[^\W\d_]+)*(?![\w@])))+")
LOWER_PART = re.compile(r"[^\W\d_]\.(?!\w)|[^\W\d_]+(?:-[^\W\d_]+)*")

_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|punto|point)\s?[\])}]\s?| dot )"
_AT = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|arroba)\s?[\])}]\s?|&#64;|%40|＠| at (?=[\w-]+ dot ))"
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w+-]*(?:\.[\w+-]+)*{_AT}[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z0-9][\w-]*)+", re.I)
#: the sign or word between mailbox and domain, which starts right behind the mailbox or a blank further on; the worded one is rare
_AT_SIGN = re.compile(r"[@＠\[({&%](?:(?<=[@＠])|(?<=[\[({])\s?(?:at|arroba)\s?[\])}]|(?<=&)#64;|(?<=%)40)", re.I)
_AT_WORD = re.compile(r" at (?=[\w-]+ dot )", re.I)
_EMAIL_HINTS = ("@", "＠", "(at", "[at", "{at", "( at", "[ at", "arroba", "&#64;", "%40", " dot ", "(AT", "[AT")

_X = rf"(?:{_L}|[\d'’-])"
#: house number, street name, kind of street, unit; a unit may also stand before
HOUSE_FIRST = re.compile(
    rf"\d(?<![\w.,#/-]\d)\d{{0,4}}[a-z]?(?: [nsew]\.| north| south| east| west)?(?: {_W}{_X}+){{1,3}}? (?:street|st\.|st(?!\w)|road|rd\.?|avenue|ave\.?|court|ct\.?|lane|ln\.?|close|terrace|drive|way|boulevard|blvd\.?|square|crescent|row)(?!\w)(?:,? (?:apt\.?|apartment|flat|unit|suite|floor) ?\d*[a-z]?(?!\w)|,? #\d+[a-z]?)?",
    re.I,
)
_UNIT_BEFORE = re.compile(r"(?<!\w)(?:flat|unit|apt\.?|apartment|suite|floor) \d+[a-z]?, $", re.I)
#: a street in one word (or a preposition and one), then the house number
_HOUSE_LAST = re.compile(r" \d{1,4}(?: ?[a-z])?(?!\w)(?:, (?:\d+\. (?:og|stock|etage)|eg)(?!\w))?", re.I)
_STREET_ENDS = ("straße", "strasse", "stra\x9fe", "straã\x9fe", "str.", "weg", "gasse", "allee", "platz", "ufer", "damm", "ring")
_PLACE_ENDS = ("graben", "berg", "ufer", "markt", "tor", "hang", "park", "bach", "see")
_STREET_WORD = re.compile(rf"(?<!\w){_W}{_X}{{5,}}\.?$")
_PLACE_WORDS = re.compile(rf"(?<!\w)(?:am|an der|zum) {_W}{_X}+$", re.I)
#: other orders, each only where one of its words stands
_NUMBER_STREET = (("rue", "chemin", "boulevard", "bd ", "avenue", "impasse", "quai", "place", "all", "cours"), re.compile(rf"\d(?<![\w.,/-]\d)\d{{0,3}}(?: (?:bis|ter|quater))?,? (?:rue|chemin|boulevard|bd|avenue|impasse|quai|place|allée|allÃ©e|cours) (?:de la |de l['’]|du |des |de |d['’])?{_W}{_X}*(?:, (?:\d+e étage|b[âa]t\.? \w+|appt\.? \w+))?", re.I))
_STREET_NUMBER = (("calle", "c/", "avenida", "avda", "av.", "plaza", "paseo", "camino", "ronda"), re.compile(rf"(?<!\w)(?:calle|c/|avenida|avda\.?|av\.|plaza|paseo|camino|ronda)(?: (?:de las|de los|de la|del|de))? {_W}{_X}+(?: {_W}{_X}+)?,? (?:n\.º ?|nº ?|n\.Âº ?|n\.o ?)?\d{{1,4}}(?:, (?:\d+\.(?:º|Âº|o)(?: [a-z](?!\w))?|bajo|ático|Ã¡tico))?", re.I))


_DIGITS = re.compile(r"\d+")


def digit_groups(text: str) -> list[tuple[int, int]]:
    """Spans of the rows of digits: found once, where each pattern would look through the text for itself."""
    return [m.span() for m in _DIGITS.finditer(text)]


def addresses(text: str, groups: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int]]:
    """Spans of address candidates; groups are the text's digit_groups."""
    groups = digit_groups(text) if groups is None else groups
    past = 0
    for a, e in groups:
        # a letter may stand behind the number, then a blank and a word
        blank = text.find(" ", e, e + 2)
        if blank >= 0 and text[blank + 1 : blank + 2] > "9" and e - a < 6 and a >= past and (m := HOUSE_FIRST.match(text, a)):
            past = m.end()
            before = _UNIT_BEFORE.search(text, max(0, a - 16), a)
            yield before.start() if before else a, past
    lower = text.lower()
    if len(lower) == len(text):
        for g, e in groups:
            a = g - 1
            if a < 0 or e - g > 4 or text[a] != " ":
                continue
            if lower.endswith(_STREET_ENDS, max(0, a - 10), a):
                pattern = _STREET_WORD
            elif lower.endswith(_PLACE_ENDS, max(0, a - 10), a):
                pattern = _PLACE_WORDS
            else:
                continue
            m = _HOUSE_LAST.match(text, a)
            word = m and pattern.search(text, max(0, a - 40), a)
            if word:
                yield word.start(), m.end()
    hints, pattern = _NUMBER_STREET
    past = 0
    for a, e in groups:
        blank = text.find(" ", e, e + 2)
        if blank >= 0 and text[blank + 1 : blank + 2] > "9" and e - a < 5 and a >= past and (m := pattern.match(text, a)) and any(h in lower for h in hints):
            past = m.end()
            yield a, past
    hints, pattern = _STREET_NUMBER
    for h in hints:
        if h in lower:
            for m in pattern.finditer(text):
                yield m.span()
            break


_CAPITAL = re.compile(r"[A-ZÀ-Þ]")

#: a number as it may be written: groups of digits with single separators, country code, brackets, extension
NUMBER = re.compile(
    r"(?<![\w@#/+.-])(?:(?:\(\+\d{1,3}\)|\+\d{1,3})[  .-]?)?(?:\(\d{2,4}\)[  .-]?)?[A-Z]{0,2}-?\d+(?:[  .-](?:\(\d+\)|\d+))*(?:-?[A-Z](?!\w))?(?:,? ?(?:ext\.?|extension|x|Durchwahl|poste) ?\d{1,5})?(?![\w@/])"
)
_DATE = re.compile(r"(?:19|20)\d\d[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d\d|(?:19|20)\d\d")
#: the lookahead spares most characters the list of words
_PHONE_CUE = re.compile(r"(?=[tpfvrcdmal])(?:tel|tél|phone|telefon|telefono|teléfono|téléphone|fax|voice|ring|call|dial|text me|cell|mobile|mobil|rückruf|anruf|appelez|llame|móvil|\bt)\W*(?:\w+\W+){0,2}$", re.I)
_ID_CUE = re.compile(r"(?=[sprmtdni])(?:ssn|social security|social insurance|passport|passeport|pasaporte|reisepass|student (?:no|number|id)|matriculation|matrikel\w*|tax|steuer-?id\w*|steuernummer|dni|nie|nif|\bid|national id\w*|numéro|sécurité sociale)\W*(?:(?:no|nr|number|num|id)\b\W*)?$", re.I)
_NOT_CUE = re.compile(r"(?=[iovtrpfcs])(?:invoice|order|version|isbn|ticket|room|page|form|code|rechnung|facture|factura|seite|página|serial|request)\W*#?$", re.I)
_FORMS = [
    (re.compile(p), phone, idnum)
    for p, phone, idnum in (
        (r"(?:\(\+\d{1,3}\)|\+\d{1,3}).*", 7, -6),
        (r"00[1-9]\d[ .-].*", 6, -2),
        (r"(?:1[ .-])?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?:\D+\d{1,5})?", 5, -3),
        (r"(?:1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]?\d{4}(?:\D+\d{1,5})?", 6, -3),
        (r"\(?0\d{1,4}\)?[ .-].*\d", 2.5, -1),
        (r"0\d[ .]\d\d[ .]\d\d[ .]\d\d[ .]\d\d", 4, -3),
        (r"\(?0\d{2,4}\)?[ -]\d{3,5}[ -]\d{3,4}", 3, -3),
        (r"[6-9]\d\d[ -]\d{3}[ -]\d{3}", 3.5, -1),
        (r"\d{10}", 1.5, -1.5),
        (r"0\d{9,10}", 1.0, -0.5),
        (r"9\d{8}", -0.5, -0.5),
        (r"\d{3}[- .]\d{2}[- .]\d{4}", -3, 3.5),
        (r"\d{9}", -1.5, 0.0),
        (r"[A-Z]\d{7,8}", -9, 2.5),
        (r"[A-Z]{2}-\d{4}-\d{5}", -9, 3.0),
        (r"\d{8}-?[A-Z]", -9, 3.5),
        (r"\d\d\.\d{3}\.\d{3}-?[A-Z]", -9, 4.5),
        (r"\d\d \d{3} \d{3} \d{3}", -1.5, 2.5),
        (r"\d{11}", -1, 0.0),
        (r"\d{8}", -2, -1.0),
        (r"97[89]-.*", -9, -9),
    )
]
_LETTERED = re.compile(r"[A-Z]")
#: mailboxes of offices, not of people (fixed values)
_ROLES = {"info", "office", "admissions", "webmaster", "contact", "school", "mail", "help", "support", "hello", "news", "press", "secretary", "registrar", "noreply", "admin", "team", "mailto", "email", "courriel", "correo"}
#: titles and openings before a name, and nouns after a name that make it a place or an institution (fixed values)
_TITLES = {"dr", "prof", "coach", "mr", "mrs", "ms", "miss", "frau", "herr", "mme", "mlle", "madame", "monsieur", "sr", "sra", "srta", "profesora", "profesor"}
_BEFORE = {"dr", "prof", "coach", "mr", "mrs", "ms", "miss", "frau", "herr", "mme", "m", "mlle", "madame", "monsieur", "sr", "sra", "srta", "don", "doña", "dean", "by", "laut", "selon", "segun", "to", "thank", "with", "than", "par", "por", "von", "about", "is", "was", "profesora", "profesor"}
_AFTER = {"hall", "library", "academy", "college", "school", "lycée", "lycee", "école", "ecole", "schule", "kolleg", "instituto", "colegio", "gymnasium", "university", "house", "studio", "street", "st", "road", "rd", "avenue", "ave", "court", "lane", "close", "terrace", "drive", "way", "building", "center", "centre", "theatre", "society", "club"}


@lru_cache(1 << 16)
def folded(word: str) -> str:
    """A word type: damaged bytes mended, no accents, lower case."""
    if not word.isascii():
        if "Ã" in word:
            try:
                word = word.encode("latin-1").decode("utf-8")
            except UnicodeError:
                pass
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return word.lower()


@lru_cache(1 << 16)
def _pieces(token: str) -> tuple[str, ...]:
    return tuple(p for p in folded(token).split("-") if p)


@lru_cache(1 << 16)
def _keys(token: str) -> tuple[str, ...]:
    """The parts of a word that link it to others."""
    return tuple(p for p in _pieces(token) if len(p) > 2 and p not in _AFTER and p not in _BEFORE)


@lru_cache(1 << 16)
def _code(name: str) -> int:
    return zlib.crc32(name.encode())


def _local_words(email: str) -> list[str]:
    local = re.split(r"[^\w.+-]|[@＠]", email)[0].lower().split("+")[0]
    return [p for p in re.split(r"[^a-z]+", local) if len(p) > 2 and p not in _ROLES]


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of e-mail candidates: EMAIL, tried only where a mailbox stands before a sign."""
    for h in _EMAIL_HINTS:
        if h in text:
            break
    else:
        return []
    ends = [m.start() for m in _AT_SIGN.finditer(text)]
    if " dot " in text.lower():
        at = _AT_WORD.search(text)
        while at:  # two of them may share a blank
            ends.append(at.start())
            at = _AT_WORD.search(text, at.start() + 1)
        ends.sort()
    out, past = [], 0
    for e in ends:
        a = e - 1 if e and text[e - 1].isspace() else e
        # a mailbox is all of its characters before the sign, since none may stand before it
        while a and ((c := text[a - 1]).isalnum() or c in "_.+-"):
            a -= 1
        if a >= past and (m := EMAIL.match(text, a)):
            out.append(m.span())
            past = m.end()
    return out


@lru_cache(1 << 14)
def _run_types(run: str) -> list[str]:
    """The word types that a run counts for."""
    tokens = PART.findall(run)
    return [p for token, after in zip(tokens, [*tokens[1:], ""]) if len(token) > 2 and folded(after) not in _AFTER for p in _pieces(token) if len(p) > 2]


def _count_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over distinct runs and distinct addresses of a batch: a footer or a copied text counts once."""
    for b in batches:
        runs: Counter = Counter()
        mails: Counter = Counter()
        seen_mails: set[str] = set()
        seen_runs: set[str] = set()
        for t in b.column(0).to_pylist():
            if t:
                seen_mails.update(t[a:e].lower() for a, e in emails(t))
                seen_runs.update(RUN.findall(t))
        for mail in seen_mails:
            mails.update(_local_words(mail))
        for run in seen_runs:
            runs.update(_run_types(run))
        types = list({**runs, **mails})
        yield pa.RecordBatch.from_arrays([pa.array(types, pa.string()), pa.array([runs[x] for x in types], pa.int64()), pa.array([mails[x] for x in types], pa.int64())], ["type", "runs", "mails"])


def word_types(documents: DataFrame) -> DataFrame:
    """(type, runs, mails): how often a word type stands in runs of capitalised words and in e-mail addresses."""
    counted = documents.select("text").mapInArrow(_count_types, "type string, runs long, mails long")
    return counted.groupBy("type").agg(F.sum("runs").alias("runs"), F.sum("mails").alias("mails")).where("runs > 0")


#: start and end in the run, word, initial, score, whether addresses hold all its pieces, whether the score says anything, keys
_Part = tuple[int, int, str, bool, float, bool, bool, tuple[str, ...]]


def _promising(parts: list[_Part]) -> bool:
    """One of the words may be of a name, or a title stands before one."""
    return any(p[4] > -2.0 and not p[3] for p in parts) or any(folded(p[2]) in _TITLES for p in parts[:-1])


class Lexicon:
    """Log-odds that a word type is a name: affixes, fitted to `types`, and exact counts.

    known holds the counts of the types at hand; rate is how often a name of the runs stands in an address.
    """

    BITS = 16

    def __init__(self, types: list[tuple[str, int, int]], rate: float, known: dict[str, tuple[int, int]] | None = None):
        self.rate = rate
        # without a mention in any address a type is an example of other words only if names as frequent would have one
        chosen = [t for t in sorted(types, key=lambda r: (-r[1], r[0])) if t[2] or self.rate * t[1] > 1.5]
        self.weights = np.zeros(1 << self.BITS)
        self.bias = 0.0
        y = np.array([m > 0 for _, _, m in chosen], float)
        if 0 < y.sum() < len(y):
            weight = np.where(y > 0, 1.0 + np.log1p([m for *_, m in chosen]), np.minimum(np.log1p([r for _, r, _ in chosen]), 3.0))
            rows = [self._features(t) for t, *_ in chosen]
            index = np.concatenate(rows)
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            for _ in range(60):
                z = np.bincount(owner, self.weights[index], minlength=len(rows)) + self.bias
                g = weight * (y - 1 / (1 + np.exp(-z)))
                self.weights += 0.2 * (np.bincount(index, g[owner], minlength=len(self.weights)) / (1 + np.bincount(index, weight[owner], minlength=len(self.weights)) ** 0.5) - 0.002 * self.weights)
                self.bias += 0.5 * g.sum() / weight.sum()
        self.known = {t: (r, m) for t, r, m in types} if known is None else known
        self.cache: dict[str, tuple[float, bool, bool]] = {}
        self.runs: dict[str, tuple[list[_Part], bool]] = {}

    def _features(self, word: str) -> np.ndarray:
        found = [f"{k}{word[:k]}<" for k in (3, 4, 5) if len(word) > k] + [f">{word[-k:]}" for k in (3, 4, 5) if len(word) > k]
        return np.array([hash_(x) & ((1 << self.BITS) - 1) for x in found], np.int64)

    def piece(self, word: str) -> tuple[float, bool]:
        """The score of a piece, and whether it says anything: an address, counts enough to miss one, or telling affixes."""
        if word in _AFTER or word in _BEFORE:
            return -9.0, True
        f = self._features(word)
        z = float(np.clip(self.bias + (self.weights[f].sum() if len(f) else 0.0), -4, 4))
        runs, mails = self.known.get(word, (0, 0))
        exact = 3.0 + np.log1p(mails) if mails else -min(5.0, 0.35 * self.rate * runs)
        return z + exact, mails > 0 or self.rate * runs > 1.0 or abs(z - self.bias) > 0.7

    def __call__(self, token: str) -> tuple[float, bool, bool]:
        """The score of a token, whether addresses hold all its pieces, and whether the score says anything."""
        if token not in self.cache:
            pieces = _pieces(token)
            scores, told = zip(*map(self.piece, pieces)) if pieces else ((-9.0,), (True,))
            score = min(scores)
            self.cache[token] = (score, score > 0 and all(self.known.get(p, (0, 0))[1] > 0 for p in pieces), told[scores.index(score)])
        return self.cache[token]

    def parts(self, run: str, lower: bool) -> tuple[list[_Part], bool]:
        """The words and initials of a run, and whether they alone make a name possible. Runs repeat, so short ones are kept for a while."""
        held = self.runs.get(run)
        if held is None:
            parts = []
            for p in (LOWER_PART if lower else PART).finditer(run):
                word = p.group()
                initial = len(word) == 2 and word[1] == "."
                score, exact, told = (0.0, False, True) if initial else self(word)
                parts.append((p.start(), p.end(), word, initial, score, exact, told, () if initial else _keys(word)))
            held = parts, _promising(parts)
            if len(run) < 80:
                if len(self.runs) >= 1 << 14:
                    self.runs.clear()
                self.runs[run] = held
        return held

    def with_counts(self, known: dict[str, tuple[int, int]]) -> "Lexicon":
        out = object.__new__(Lexicon)
        out.__dict__ = self.__dict__ | {"known": known, "cache": {}, "runs": {}}
        return out

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "runs": {}}


@lru_cache(1 << 16)
def hash_(text: str) -> int:
    h = 1469598103934665603
    for c in text.encode():
        h = ((h ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 29)


_FEATURES = 1 << 16
_EDGES = 6  # separators 1 to 4, skip edges; 0 is no edge


def _indices(names: list[str]) -> list[int]:
    return [_code(f) % _FEATURES for f in names]


class Token:
    """A node: span, score of its word (None: composite), run it stands in, its features (blind: those that are left where its word or cue says nothing), and the contents that link it to others."""

    __slots__ = ("a", "e", "text", "initial", "score", "run", "allowed", "features", "blind", "told", "keys", "guess", "clear")

    def __init__(self, a: int, e: int, text: str, allowed: tuple[int, ...], run: int = -1, initial: bool = False, score: float | None = None, told: bool = True):
        self.a, self.e, self.text, self.allowed, self.run, self.initial, self.score = a, e, text, allowed, run, initial, score
        self.told = told
        self.features: list[int] = []
        self.blind: list[int] = []
        self.keys: tuple[str, ...] = ()
        self.guess, self.clear = _O, False


_WORD_LABELS = (_O, _B, _I)
_DOTTED_TITLES = tuple(f"{t.capitalize()}. " for t in sorted(_TITLES))  # without a dot, title and word are a run
_DOTTED = re.compile(rf"[{''.join(sorted({t[0] for t in _DOTTED_TITLES}))}](?:{'|'.join(re.escape(t[1:]) for t in _DOTTED_TITLES)})")
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(t) for t in _DOTTED_TITLES)})({_NAMEWORD})(?![\w@-])(?! {_UP})")


def _runs(text: str, lexicon: Lexicon, taken: list[tuple[int, int]]) -> list[tuple[int, list[_Part], bool]]:
    """Runs of capitalised words (start, parts, whether they are promising); in a text without capitals, of words that addresses hold."""
    out: list[tuple[int, list[_Part], bool]] = []
    lower = text.islower()
    taken = sorted(taken)  # these do not overlap, so their ends are sorted too
    ends = [y for _, y in taken]
    for m in (LOWER_RUN if lower else RUN).finditer(text):
        base, end = m.span()
        parts, promising = lexicon.parts(m.group(), lower)
        i = bisect.bisect_right(ends, base)
        met = i < len(taken) and taken[i][0] < end
        if not met and not lower:
            if len(parts) > 1:
                out.append((base, parts, promising))
            continue
        held: list[_Part] = []
        for p in [*parts, None]:
            if p is not None and (not lower or p[3] or p[5]):
                i = bisect.bisect_right(ends, base + p[0]) if met else len(taken)
                if i == len(taken) or taken[i][0] >= base + p[1]:
                    held.append(p)
                    continue
            if len(held) > 1:
                out.append((base, held, _promising(held)))
            held = []
    return out


def _nodes(base: int, parts: list[_Part]) -> list[Token]:
    out = []
    for a, e, word, initial, score, _, told, keys in parts:
        t = Token(base + a, base + e, word, _WORD_LABELS, 0, initial, score, told)
        t.keys = keys
        out.append(t)
    return out


def word_tokens(text: str, lexicon: Lexicon, taken: list[tuple[int, int]]) -> list[list[Token]]:
    """Runs that may hold a name: one of their words may be of a name, a title stands before, or they share a word with such a run.

    Words whose score, place and company leave only `other` need no inference.
    """
    runs = _runs(text, lexicon, taken)
    hopeful, rest, shared = [], [], set()
    for base, parts, promising in runs:
        if promising or _word_before(text, base + parts[0][0]) in _TITLES:
            hopeful.append(_nodes(base, parts))
            for p in parts:
                shared.update(p[7])
        else:
            rest.append((base, parts))
    lone = []
    if _DOTTED.search(text):
        spans = [(base + p[0], base + p[1]) for base, parts, _ in runs for p in parts] + taken
        for m in _TITLED.finditer(text):
            a, e = m.span(1)
            if folded(m.group(1)) not in _AFTER and not any(x < e and a < y for x, y in spans):
                score, _, told = lexicon(m.group(1))
                t = Token(a, e, m.group(1), _WORD_LABELS, 0, False, score, told)
                t.keys = _keys(t.text)
                lone.append([t])
                shared.update(t.keys)
    if shared:
        hopeful += [_nodes(base, parts) for base, parts in rest if any(not shared.isdisjoint(p[7]) for p in parts)]
    out = sorted(hopeful + lone, key=lambda tokens: tokens[0].a)
    for i, tokens in enumerate(out):
        for t in tokens:
            t.run = i
    return out


_LAST_WORD = re.compile(rf"({_W}+)\W{{1,2}}$")
_NEXT_WORD = re.compile(rf" ({_W}+)")


#: of the characters of ASCII those that are not of words
_MARKS = "".join(c for c in map(chr, range(128)) if not (c.isalnum() or c == "_"))


def _word_before(text: str, a: int) -> str:
    window = text[max(0, a - 24) : a]
    if window.isascii():
        # the same as the pattern: one or two marks, which a line end may follow
        held = window.rstrip(_MARKS)
        if not 0 < len(window) - len(held) < (4 if window[-1] == "\n" else 3):
            return ""
        return held[len(held.rstrip(string.ascii_letters)) :].lower()
    m = _LAST_WORD.search(window)
    return folded(m.group(1)) if m else ""


_SCORES = (-8.0, -5.5, -4.0, -2.8, -1.8, -1.0, -0.3, 0.4, 1.2, 2.2, 3.5, 5.0, 7.0)
_COARSE = (-4.8, -1.5, 0.5, 2.5)


_NONE, _INITIAL, _UNTOLD, _FIRST_BIN = range(4)
#: coarse scores whose word may be a cue or a common word
_WEAK = {_NONE, _UNTOLD, _FIRST_BIN, _FIRST_BIN + 1}


def _binned(t: Token, blind: bool) -> tuple[int, int]:
    """Coarse and fine bin of a token's score."""
    if t.initial:
        return _INITIAL, _INITIAL
    if not t.told or blind:
        return _UNTOLD if not t.told or t.score > -8 else _FIRST_BIN, _UNTOLD
    return _FIRST_BIN + bisect.bisect_left(_COARSE, t.score), _FIRST_BIN + bisect.bisect_left(_SCORES, t.score)


def word_features(text: str, tokens: list[Token], fitting: bool = False) -> None:
    """Features of the tokens of one run; in fitting also those with which it would be seen if no word told anything.

    A feature is the hash of a tuple of whole numbers, which is the same in every process.
    """
    n = len(tokens)
    before = _word_before(text, tokens[0].a)
    after = _NEXT_WORD.match(text, tokens[-1].e, tokens[-1].e + 16)
    words = ["", before, *(folded(t.text) for t in tokens), folded(after.group(1)) if after else "", ""]
    line = text.rfind("\n", 0, tokens[0].a) + 1
    opens = not text[line : tokens[0].a].strip(" -*>|")
    closes = text[tokens[-1].e : tokens[-1].e + 1] in ("", "\n", "\r")
    lower = tokens[0].text.islower()
    gaps = [0, *(_separator(text, a, b) for a, b in zip(tokens, tokens[1:])), 0]
    initial = [0, *(int(t.initial) for t in tokens), 0]
    for blind in (False, True) if fitting else (False,):
        bins = [(_NONE, _NONE)] * 2 + [_binned(t, blind) for t in tokens] + [(_NONE, _NONE)]
        for i, t in enumerate(tokens):
            s0, s1 = gaps[i], gaps[i + 1]
            cue, follow = words[i + 1], words[i + 3]
            place = 2 if follow in _AFTER else 1 if words[i + 4 : i + 5] and words[i + 4] in _AFTER else 0
            title = 2 if cue in _TITLES else 1 if cue in _BEFORE else 0
            far = words[i] in _TITLES
            form = (((initial[i + 1] * 5 + s0) * 2 + initial[i]) * 5 + s1) * 2 + initial[i + 2]
            (own, bin_), p, q = bins[i + 2], bins[i + 1][0], bins[i + 3][0]
            word = words[i + 2] if own in (_FIRST_BIN, _FIRST_BIN + 1) else None
            found = _word_hashes(
                form, s0, s1, title, far, place, opens and not i, closes and i == n - 1, min(n, 5), lower, bins[i][0], p, own, bin_, q, cue if p in _WEAK else None, follow if q in _WEAK else None, word
            )
            if blind:
                t.blind = found
            else:
                t.features = found


@lru_cache(1 << 14)
def _word_hashes(form, s0, s1, title, far, place, first, last, n, lower, pp, p, own, bin_, q, cue, follow, word) -> list[int]:
    """The features of a word; the list is shared and must not be changed."""
    return [
        hash(x) % _FEATURES
        for x in (
            (1, 0), (2, form), (3, title, far, form), (4, place, s0, s1), (5, first, last, n, own), (6, bin_), (7, bin_, n == 1), (8, p, s0, own), (9, own, s1, q), (10, p, s0, own, s1, q),
            (11, 1 if cue is None else _code(cue)), (12, 1 if follow is None else _code(follow)), (13, title, own, q, s1), (14, far, p, own, s0), (15, place, own), (16, lower, own), (17, q, bin_, s1, title), (18, p, bin_, s0, far),
            (19, pp, p, own), (20, p, own, 0 if word is None else _code(word)), (21, title == 2 or far, own, q, s1, p),
        )
    ]


def _separator(text: str, a: Token | None, b: Token | None) -> int:
    """0 none, 1 a blank, 2 a comma, 3 a line end; 4: next to each other in a contact block."""
    if a is None or b is None:
        return 0
    gap = text[a.e : b.a]
    if a.run == b.run and a.run >= 0:
        return 3 if "\n" in gap else 2 if gap.startswith(",") else 1
    return 4 if len(gap) < 8 and not any(c.isalnum() for c in gap) else 0


_SHAPES = re.compile(r"\d+")


def number_features(text: str, t: Token, fitting: bool = False) -> None:
    s = t.text
    before = text[max(0, t.a - 40) : t.a]
    cue = "i" if _ID_CUE.search(before) else "p" if _PHONE_CUE.search(before) else "n" if _NOT_CUE.search(before) else "-"
    shape = _SHAPES.sub(lambda m: str(len(m.group())), s)
    forms = [i for i, (form, *_) in enumerate(_FORMS) if form.fullmatch(s)]
    form = forms[0] if forms else "-"
    digits = sum(c.isdigit() for c in s)
    rest = ["nb", f"nf{form}", f"ns{shape}", f"nd{digits}", f"n0{s[0]}{s[1:2] == '0'}", f"na{bool(_LETTERED.search(s))}{digits}", *(f"nm{i}" for i in forms)]
    t.features = _indices([*rest, f"nc{cue}", f"nk{cue}{form}", f"nw{_word_before(text, t.a)}"])
    if fitting:
        t.blind = _indices([*rest, "nc?"])


def tokens_of(text: str, lexicon: Lexicon, fitting: bool = False) -> tuple[list[Token], list[list[Token]]]:
    """All tokens of a text in order, with features and links, and the runs among them."""
    out = []
    taken = emails(text)
    for a, e in taken:
        t = Token(a, e, text[a:e], (_O, _EMAIL))
        t.features, t.keys = _indices(["mb", f"m{'@' in t.text}"]), ("@" + re.sub(r"\W", "", t.text).lower(),)
        out.append(t)
    groups = digit_groups(text)
    if groups:
        for a, e in addresses(text, groups):
            if not any(x < e and a < y for x, y in taken):
                taken.append((a, e))
                t = Token(a, e, text[a:e], (_O, _ADDRESS))
                t.features, t.keys = _indices(["hb", f"hc{bool(_CAPITAL.search(t.text))}{text.islower()}"]), ("#" + folded(t.text),)
                out.append(t)
        for a, e in numbers(text, taken, groups):
            taken.append((a, e))
            t = Token(a, e, text[a:e], (_O, _PHONE, _ID))
            number_features(text, t, fitting)
            t.keys = (re.sub(r"\D", "", t.text),)
            out.append(t)
    runs = word_tokens(text, lexicon, taken)
    for tokens in runs:
        word_features(text, tokens, fitting)
        out += tokens
    return sorted(out, key=lambda t: (t.a, t.e)), runs


def guesses(text: str, tokens: list[Token], runs: list[list[Token]]) -> None:
    """Labels from afar for fitting: guess of every token, and whether the rules are clear about it."""
    for t in tokens:
        if t.allowed[-1] == _EMAIL:
            t.guess, t.clear = _EMAIL, True
        elif t.allowed[-1] == _ADDRESS:
            t.guess, t.clear = (_ADDRESS if _CAPITAL.search(t.text) or text.islower() else _O), True
        elif t.allowed[-1] == _ID:
            phone, idnum = number_scores(text, t.a, t.e)
            t.guess = _O if max(phone, idnum) <= 0 else _PHONE if phone >= idnum else _ID
            t.clear = abs(max(phone, idnum)) > 0.6 and (max(phone, idnum) < 0 or abs(phone - idnum) > 1)
    strong: set[str] = set()
    for run in runs:
        if len(run) == 1:
            t = run[0]
            t.guess, t.clear = (_B if t.score > -1.5 else _O), t.score > 1.0
            if t.clear:
                strong.update(t.keys)
            continue
        flat = [(t.a, t.e, t.initial, t.score) for t in run]
        i = 0
        while i < len(run):
            before = _word_before(text, run[i].a)
            bonus = 5.0 if before in _TITLES else 2.0 if before in _BEFORE else 0.0
            found = _name_at(text, flat, i, bonus)
            if found is None:
                run[i].clear = True
                i += 1
                continue
            j, score = found
            for k in range(i, j + 1):
                run[k].guess, run[k].clear = (_B if k == i else _I), score > 1.0
            if score > 1.0:
                strong.update(key for t in run[i : j + 1] for key in t.keys)
            i = j + 1
    for run in runs:  # words that a clear mention holds elsewhere are no clear examples of others
        for t in run:
            if t.guess == _O and (any(k in strong for k in t.keys) or t.score > 1.5):
                t.clear = False


def _name_at(text: str, tokens: list, i: int, bonus: float) -> tuple[int, float] | None:
    """Last token and score of the name that begins at token i by the rules for labels from afar; bonus for the word before it."""
    n = len(tokens)

    def sep(k: int) -> str:
        return text[tokens[k - 1][1] : tokens[k][0]]

    a, e, initial, score = tokens[i]
    if not initial and score < -4.8:
        return None
    j, initials = i + 1, 0
    comma = j < n and sep(j).startswith(",")
    if comma and (initial or "\n" in sep(j)):
        return None
    while j < n and tokens[j][2] and not (j > i + 1 and sep(j) != " "):
        initials += 1
        j += 1
        if comma:  # family name, initial
            return (j - 1, score) if score > 1.5 else None
    if j >= n or initials > 2 or initial and initials:
        return None
    s = sep(j)
    if not (comma and initials == 0) and s.startswith(","):
        return None
    other = tokens[j][3]
    total = score + other + bonus
    if initial:
        total = other - 1.0 + 0.5 * bonus
        least = other
    else:
        least = min(score, other)
    if "\n" in s:
        # a name broken by a line end: both words must be clear, and the line must go on before it
        line = text.rfind("\n", 0, a) + 1
        if least < 2.5 or not text[line:a].strip() or comma:
            return None
    if least < (-4.8 if max(score, other) > 5 or bonus > 2 else -1.5) or total < 0.5 or total < 1.5 and (initial or comma):
        return None
    end = j
    if comma and j + 1 < n and tokens[j + 1][2] and sep(j + 1) == " ":
        end = j + 1
    follow = text[tokens[end][1] : tokens[end][1] + 14]
    m = re.match(r" (\w+)", follow)
    if m and folded(m.group(1)) in _AFTER:
        return None
    return end, total


def numbers(text: str, taken: list[tuple[int, int]], groups: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Spans of number candidates; groups are the text's digit_groups.

    Brackets, a letter and an extension put at most 15 characters between two digits of a number, and at most
    three stand before its first digit and after its last. So only stretches of seven digits or more are searched.
    """
    groups = digit_groups(text) if groups is None else groups
    out, i = [], 0
    while i < len(groups):
        first, last = groups[i]
        digits = last - first
        i += 1
        while i < len(groups) and groups[i][0] - last <= 16:
            digits += groups[i][1] - groups[i][0]
            last = groups[i][1]
            i += 1
        for m in NUMBER.finditer(text, max(0, first - 3), last + 16) if digits >= 7 else ():
            a, e = m.span()
            if e - a >= 7 and 7 <= sum(map(str.isdigit, m.group())) <= 18 and not _DATE.fullmatch(m.group()) and not any(x < e and a < y for x, y in taken):
                out.append((a, e))
    return out


def number_scores(text: str, a: int, e: int) -> tuple[float, float]:
    """What the rules say of a number as (phone, idnum), for labels from afar."""
    s = text[a:e]
    phone, idnum = -2.0, -2.0
    for form, p, i in _FORMS:
        if form.fullmatch(s):
            phone, idnum = max(phone, p) if p > 0 else (p if phone <= 0 else phone), max(idnum, i) if i > 0 else (i if idnum <= 0 else idnum)
    before = text[max(0, a - 40) : a]
    if _ID_CUE.search(before):
        idnum, phone = idnum + 6, phone - 4
    elif _PHONE_CUE.search(before):
        phone, idnum = phone + 4, idnum - 3
    elif _NOT_CUE.search(before):
        phone, idnum = phone - 7, idnum - 7
    if _LETTERED.search(re.sub(r"ext\.?.*|x ?\d+$", "", s)):
        phone = -9.0
    return phone, idnum


class Graph:
    """Tokens of many texts as arrays: features, allowed labels and edges."""

    def __init__(self) -> None:
        self.index: list[list[int]] = []
        self.blind: list[list[int]] = []
        self.allowed: list[tuple[int, ...]] = []
        self.edges: list[tuple[int, int, int]] = []

    def add(self, text: str, tokens: list[Token]) -> None:
        first = len(self.index)
        last: dict[str, int] = {}
        self.index += [t.features for t in tokens]
        self.blind += [t.blind or t.features for t in tokens]
        self.allowed += [t.allowed for t in tokens]
        for i, t in enumerate(tokens, first):
            if i > first:
                kind = _separator(text, tokens[i - first - 1], t)
                if kind:
                    self.edges.append((i - 1, i, kind))
            # a chain through the mentions of one content joins them all without joining each pair
            for k in t.keys:
                if k in last and last[k] != i and (last[k], i) != (i - 1, i):
                    self.edges.append((last[k], i, 5))
                last[k] = i

    def arrays(self, blind: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(feature index, first feature of each token, mask of labels, edges)."""
        rows = self.blind if blind else self.index
        kinds = {labels: i for i, labels in enumerate(dict.fromkeys(self.allowed))}
        masks = np.full((len(kinds), _K), -1e3)
        for labels, i in kinds.items():
            masks[i, list(labels)] = 0.0
        mask = masks[np.fromiter(map(kinds.__getitem__, self.allowed), np.int64, len(rows))]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        index = np.array(list(chain.from_iterable(rows)), np.int64)
        return index, np.cumsum(sizes) - sizes, mask, np.array(self.edges, np.int64).reshape(-1, 3)


class Field:
    """Weights: unary[feature, label], pair[kind of edge, label, label]."""

    def __init__(self) -> None:
        self.unary = np.zeros((_FEATURES, _K))
        self.pair = np.zeros((_EDGES, _K, _K))

    def scores(self, index: np.ndarray, starts: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.unary[index], starts, axis=0) + mask if len(starts) else mask

    def fit(self, graph: Graph, label: np.ndarray, clear: np.ndarray, rounds: int = 50, decay: float = 4e-6) -> "Field":
        """Climbs the pseudo-likelihood of the labels of the clear tokens, by Adagrad.

        Every token is seen twice: with all its features, and as if no word and no cue told anything, as
        with rare words in bare places. So the edges are fitted for tokens that need them.
        """
        index, starts, mask, edges = graph.arrays()
        n = len(starts)
        if not n or not clear.any():
            return self
        views = []
        used, codes = np.unique(np.concatenate([index, graph.arrays(True)[0]]), return_inverse=True)
        for codes_, at in ((codes[: len(index)], starts), (codes[len(index) :], graph.arrays(True)[1])):
            owner = np.repeat(np.arange(n), np.diff(np.append(at, len(codes_))))
            order = np.argsort(codes_, kind="stable")
            found, heads = np.unique(codes_[order], return_index=True)
            views.append((codes_, at, owner[order], found, heads))
        a, b, kind = edges.T
        target = np.zeros((n, _K), np.float32)
        target[np.arange(n), label] = 1.0
        weight = np.where(clear, np.float32(1), np.float32(0))[:, None]
        unary, pair = np.zeros((len(used), _K), np.float32), self.pair
        past = np.full(unary.shape, 1e-2, np.float32), np.full(pair.shape, 1e-2)
        mask = mask.astype(np.float32)
        for _ in range(rounds):
            near = np.zeros((n, _K))
            np.add.at(near, b, pair[kind, label[a]])
            np.add.at(near, a, pair[kind, :, label[b]])
            near = near.astype(np.float32) + mask
            step, step_pair = -decay * n * unary, -decay * n * pair
            for codes_, at, by_feature, found, heads in views:
                z = np.add.reduceat(unary[codes_], at, axis=0) + near
                q = np.exp(z - z.max(1, keepdims=True))
                g = (target - q / q.sum(1, keepdims=True)) * weight
                step[found] += np.add.reduceat(g[by_feature], heads, axis=0)
                np.add.at(step_pair, (kind, label[a]), g[b])
                np.add.at(step_pair, (kind, slice(None), label[b]), g[a])
            step_pair[5] = (step_pair[5] + step_pair[5].T) / 2  # skip edges have no direction
            for w, d, sums, rate in ((unary, step, past[0], 0.5), (pair, step_pair, past[1], 1.5)):
                sums += d * d
                w += rate * d / np.sqrt(sums)
        self.unary[used] = unary
        return self

    def marginals(self, scores: np.ndarray, edges: np.ndarray, rounds: int = 6) -> np.ndarray:
        """Logarithms of the beliefs of all tokens after loopy sum-product message passing."""
        a, b, kind = edges.T
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        pot = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)]) if len(kind) else np.zeros((0, _K, _K))
        pot = np.exp(pot)
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))]).astype(np.int64)
        message = np.zeros((len(src), scores.shape[1]))
        # every score is the first to be added to its cell, then the messages by edge
        cells = np.concatenate([np.arange(scores.size), (dst[:, None] * scores.shape[1] + np.arange(scores.shape[1])).reshape(-1)])
        belief = scores.copy()
        for _ in range(rounds if len(src) else 0):
            cavity = belief[src] - message[back]
            cavity = np.exp(cavity - cavity.max(1, keepdims=True))
            new = np.log(np.einsum("ej,ejk->ek", cavity, pot) + 1e-300)
            message = 0.3 * message + 0.7 * (new - new.max(1, keepdims=True))
            belief = np.bincount(cells, np.concatenate([scores.reshape(-1), message.reshape(-1)])).reshape(scores.shape)
        belief -= belief.max(1, keepdims=True)
        return belief - np.log(np.exp(belief).sum(1, keepdims=True))


class Tagger:
    """Lexicon and field together: what goes to the workers."""

    def __init__(self, lexicon: Lexicon, field: Field):
        self.lexicon, self.field = lexicon, field

    def find(self, texts: list[str | None], lexicon: Lexicon | None = None, passing: bool = True) -> list[tuple[int, int, int, int]]:
        """(text, start, end, label) of the items of a batch of texts; passing=False leaves out all edges."""
        graph, nodes = Graph(), []
        for d, t in enumerate(texts):
            if t:
                tokens, _ = tokens_of(t, lexicon or self.lexicon)
                graph.add(t, tokens)
                nodes += [(d, x) for x in tokens]
        if not nodes:
            return []
        index, starts, mask, edges = graph.arrays()
        label = self.field.marginals(self.field.scores(index, starts, mask), edges if passing else edges[:0]).argmax(1)
        out, i = [], 0
        while i < len(nodes):
            (d, t), k = nodes[i], int(label[i])
            j = i + 1
            if k in (_B, _I):
                while j < len(nodes) and nodes[j][0] == d and nodes[j][1].run == t.run and label[j] == _I:
                    j += 1
                held = [x for _, x in nodes[i:j]]
                if len(held) > 1 and held[-1].initial and not texts[d][t.e :].startswith(","):
                    # a middle initial asks for the family name behind it
                    more = j < len(nodes) and nodes[j][0] == d and nodes[j][1].run == t.run and not nodes[j][1].initial and texts[d][held[-1].e] == " "
                    held = [*held, nodes[j][1]] if more and held[0].initial is False else []
                    j += bool(more)
                if len(held) > 1 and any(not x.initial for x in held):
                    out.append((d, t.a, held[-1].e, _B))
            elif k:
                out.append((d, t.a, t.e, k))
            i = j
        return out


_PLACEHOLDER = {k: f"[{LABELS[k].upper()}]" for k in range(1, _K)}


def _apply(shared, scrubbed: bool, counted: bool):
    """counted: each row has the counts of its own types as its last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                ids, texts, wanted = (b.column(c).slice(lo, 2000).to_pylist() for c in ("doc_id", "text", "scrub"))
                lexicon = None
                if counted:
                    lists = b.column("types").slice(lo, 2000).to_pylist()
                    lexicon = tagger.lexicon.with_counts({r["type"]: (r["runs"], r["mails"]) for rows in lists for r in rows or ()})
                found = tagger.find([t if w else None for t, w in zip(texts, wanted)], lexicon)
                if scrubbed:
                    for d, a, e, k in sorted(found, reverse=True):
                        texts[d] = texts[d][:a] + _PLACEHOLDER[k] + texts[d][e:]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
                else:
                    rows = list(dict.fromkeys((ids[d], LABELS[k], texts[d][a:e]) for d, a, e, k in found))
                    columns = list(zip(*rows)) if rows else [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "kind", "found_text"])

    return run


def _examples(shared, counted: bool, max_tokens: int):
    """One row a text: its tokens for fitting (features, allowed labels, edges, guesses)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        lexicon = shared.value
        for b in batches:
            out = []
            for r in range(b.num_rows):
                text = b.column("text")[r].as_py()
                own = lexicon.with_counts({x["type"]: (x["runs"], x["mails"]) for x in b.column("types")[r].as_py() or ()}) if counted else lexicon
                tokens, runs = tokens_of(text, own, True)
                guesses(text, tokens, runs)
                graph = Graph()
                graph.add(text, tokens[:max_tokens])
                out.append(pickle.dumps((graph.index, graph.blind, graph.allowed, graph.edges, [t.guess for t in tokens[:max_tokens]], [t.clear for t in tokens[:max_tokens]])))
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(out, pa.binary())], ["h", "tokens"])

    return run


def _own_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, type): every word type of a text that a run or a title may hold."""
    for b in batches:
        rows, types = [], []
        for row, t in zip(b.column("row").to_pylist(), b.column("text").to_pylist()):
            if t:
                found = {p for w in re.findall(LOWER_PART if t.islower() else PART, t) for p in _pieces(w)}
                rows += [row] * len(found)
                types += found
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(types, pa.string())], ["row", "type"])


def _with_types(docs: DataFrame, types: DataFrame) -> DataFrame:
    """Adds types, the counts of each text's own word types, by a join."""
    docs = docs.withColumn("row", F.xxhash64("text"))
    own = docs.select("row", "text").mapInArrow(_own_types, "row long, type string").distinct()
    own = own.join(types, "type").groupBy("row").agg(F.collect_list(F.struct("type", "runs", "mails")).alias("types"))
    return docs.join(own, "row", "left").drop("row")


def train(documents: DataFrame, *, max_types: int = 20_000, max_sample: int = 2_500, max_tokens: int = 400, bound: int = 500_000) -> tuple[Tagger, DataFrame | None]:
    """The tagger, and the table of types where there are more than `bound` (then each text is joined to its own)."""
    spark = documents.sparkSession
    ship(spark)
    types = materialise(word_types(documents), "types")
    n, total, mails = types.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("mails") > 0, F.col("runs"))), F.lit(0)), F.coalesce(F.sum("mails"), F.lit(0))).first()
    rate = mails / (total or 1)
    chosen = types.where((F.col("mails") > 0) | (F.col("runs") * rate > 1.5)).orderBy(F.desc("runs"), "type").limit(max_types).collect()
    counted = n > bound
    known = {} if counted else {r.type: (r.runs, r.mails) for r in types.toLocalIterator()}
    lexicon = Lexicon([(r.type, r.runs, r.mails) for r in chosen], rate, known)
    # the texts of the smallest hashes, about max_sample of them
    docs = documents.where(F.length("text") > 2).select("text", F.xxhash64("text").alias("h"))
    step = max(1, docs.count() // max_sample)
    sample = docs.where(F.pmod(F.col("h") + F.lit(1), F.lit(step)) == 0).dropDuplicates(["h"])
    if counted:
        sample = _with_types(sample, types)
    rows = sample.mapInArrow(_examples(spark.sparkContext.broadcast(lexicon), counted, max_tokens), "h long, tokens binary").orderBy("h").collect()
    return Tagger(lexicon, fitted([r.tokens for r in rows])), types if counted else None


def fitted(rows: list[bytes]) -> Field:
    """The field of the tokens that _examples gave."""
    import pickle

    graph, label, clear = Graph(), [], []
    for row in rows:
        index, blind, allowed, edges, guess, sure = pickle.loads(row)
        first = len(graph.index)
        graph.index += index
        graph.blind += blind
        graph.allowed += allowed
        graph.edges += [(a + first, b + first, k) for a, b, k in edges]
        label += guess
        clear += sure
    return Field().fit(graph, np.array(label, np.int64), np.array(clear, bool))


def _wanted(documents: DataFrame, sources: DataFrame) -> DataFrame:
    off = sources.where(F.col("name").isNotNull()).groupBy(F.col("name").alias("source")).agg(F.min("pii_scrub").alias("_scrub"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source").join(off, "source", "left")
    return docs.select("doc_id", "text", F.coalesce("_scrub", F.lit(True)).alias("scrub"))


def _tagged(documents: DataFrame, wanted: DataFrame, scrubbed: bool, schema: str, bound: int) -> DataFrame:
    tagger, types = train(documents, bound=bound)
    shared = documents.sparkSession.sparkContext.broadcast(tagger)
    rows = wanted if types is None else _with_types(wanted, types)
    return rows.mapInArrow(_apply(shared, scrubbed, types is not None), schema)


def items(documents: DataFrame, sources: DataFrame, *, bound: int = 500_000) -> DataFrame:
    """(doc_id, kind, found_text) of the documents whose source is not excepted."""
    return _tagged(documents, _wanted(documents, sources).where("scrub and length(text) > 2"), False, "doc_id long, kind string, found_text string", bound)


def scrub(documents: DataFrame, sources: DataFrame, *, bound: int = 500_000) -> DataFrame:
    """(doc_id, text): items replaced by placeholders of their kind, in otherwise unchanged text."""
    return _tagged(documents, _wanted(documents, sources), True, "doc_id long, text string", bound)
