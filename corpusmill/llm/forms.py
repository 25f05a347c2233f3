"""Text quality statistics and the form of each document's main body: a hidden Markov model over lines.

States are prose, list, table and junk; a line's observation is a vector of binned line statistics
(length, share of common words, of symbols and digits, word lengths, line ends, bullets, separators,
repeated word triples), taken as independent given the state. Emissions and transitions are fitted to
a bounded sample of labelled documents (`max_labelled`, the first by a hash of the id): lines start
with the label of their document and are labelled anew by the model, leaning to that label, three
times; documents whose label the model contradicts are left out of a second fit. Invented lists, tables and junk from the sample's own words stand in for kinds that it lacks.
A line of more than 240 characters is read as its sentences. The most probable path labels every
main-body line of every document; shares of the labels are by
characters. Page frames are taken out first by the frame repeats of the whole corpus.

Defined cases: null and blank texts have statistics of 0 and null shares, as have texts whose lines
are all frame; texts of fewer than three characters are no case; repeated labels count by majority
(ties are left out), letter case and blanks aside; labels of other names and of unknown documents are
left out; without labels the model falls back to flat emissions and nothing is found; repeated ids
give a row each.
"""

from __future__ import annotations

import base64
import copy
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.core.tables import materialise, ship
from corpusmill.functions.rolling import order, windows, words
from corpusmill.llm import boilerplate

STATES = ("prose", "list", "table", "junk")
#: kinds of lines that a form is made of; every kind is a state of its own
_KINDS = {"prose": 3, "list": 6, "table": 6, "junk": 9}
_LABEL = np.repeat(np.arange(len(STATES)), list(_KINDS.values()))
#: frequent function words of the corpus languages (fixed values)
COMMON = (
    "the of and to a in is it that was for on as with by at from be this have or not are but had his her they you we their which one all would there been if will has who more "
    "what so can no when out said an were he she its into than them some could my may two first then only other after before because while should "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man "
    "de la le et les des en un une du est que dans pour qui au par sur il ne pas plus se ce a avec sont son ses mais ou elle nous cette ont été aux si sans leur deux "
    "el los las y del se por con no su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde nos"
).split()
_BINS = {
    "chars": [4, 12, 22, 36, 50, 66, 85, 130, 260],
    "common": [0.001, 0.08, 0.16, 0.25, 0.35, 0.5],
    "symbols": [0.001, 0.02, 0.05, 0.1, 0.2, 0.4],
    "digits": [0.001, 0.03, 0.1, 0.25, 0.5],
    "mean_word": [2, 3, 4, 5, 6.5, 9, 15],
    "max_word": [6, 9, 12, 15, 20, 40],
    "repeated": [0.001, 0.1, 0.3, 0.6, 0.9],
    "separators": [0.001, 0.1, 0.25, 0.5, 1.0],
    "words": [1, 2, 3, 5, 8, 12, 20],
    "gaps": [1, 2, 3],
}
_FIRST = {**dict.fromkeys(b"-*+", 1), **dict.fromkeys(b"0123456789", 2), **dict.fromkeys(b"[(", 3), **dict.fromkeys(b"|", 4), **dict.fromkeys(b"\"'", 5)}
_LAST = {**dict.fromkeys(b".!?", 1), **dict.fromkeys(b",;:", 2), **dict.fromkeys(b")]}", 3), **dict.fromkeys(b"|", 4), **dict.fromkeys(b"0123456789", 5)}
_LONG = 240
#: characters of the texts that are worked off at once
_CHUNK = 600_000
_SIZES = [len(b) + 1 for b in _BINS.values()] + [7, 7]
_LETTER, _DIGIT, _SPACE, _SYMBOL = range(4)
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[:33] = _SPACE
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b"|;,\t")] = True
_EDGE = np.zeros((2, 256), np.uint8)
_EDGE[:] = 6
_EDGE[:, ord("a") : ord("z") + 1] = 0
for _row, _map in zip(_EDGE, (_FIRST, _LAST)):
    for _c, _v in _map.items():
        _row[_c] = _v
_FUNCTION_WORDS = frozenset(COMMON)
_COMMON_HASHES = np.sort(words([boilerplate.fold(w) for w in dict.fromkeys(COMMON)])[0])
_COMMON_BITS = np.zeros(1 << 16, bool)
_COMMON_BITS[_COMMON_HASHES.astype(np.uint16)] = True


class Lines:
    """Statistics of lines; doc gives the document of each (in order)."""

    def __init__(self, lines: list[bytes], doc: np.ndarray):
        n = len(lines)
        self.doc = doc
        blob = np.frombuffer(b"\n".join([*lines, b""]), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]).astype(np.int64)
        kind = _KIND[blob]

        def count(flags: np.ndarray) -> np.ndarray:
            return np.add.reduceat(flags, at[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)

        self.letters, self.digits, self.symbols = count(kind == _LETTER), count(kind == _DIGIT), count(kind == _SYMBOL)
        self.chars = at[1:] - at[:-1] - 1
        filled = self.filled = np.maximum(self.letters + self.digits + self.symbols, 1)
        hashes, offsets = words(lines)
        self.words = np.diff(offsets)
        line_of = np.repeat(np.arange(n), self.words)
        maybe = np.flatnonzero(_COMMON_BITS[hashes.astype(np.uint16)])
        common = maybe[_COMMON_HASHES[np.minimum(np.searchsorted(_COMMON_HASHES, hashes[maybe]), len(_COMMON_HASHES) - 1)] == hashes[maybe]]
        self.common = np.bincount(line_of[common], minlength=n)
        alnum = kind <= _DIGIT
        edge = np.flatnonzero(np.diff(np.concatenate([[False], alnum, [False]]).astype(np.int8)))
        longest = np.zeros(n, np.int64)
        if len(edge):  # these runs are the words
            some = np.flatnonzero(self.words)
            longest[some] = np.maximum.reduceat(edge[1::2] - edge[0::2], offsets[some])
        separator = _SEPARATOR[blob]
        gap = np.zeros(len(blob), bool)
        gap[2:] = (kind[2:] != _SPACE) & (blob[1:-1] == 32) & (blob[:-2] == 32)
        # word triples that the document has had before
        self.triples, self.repeats = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(hashes) >= 3:
            w = windows(hashes, 3)
            owner = self.doc[line_of]
            ok = owner[:-2] == owner[2:]
            key = w[ok] ^ (owner[:-2][ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            by = order(key)
            seen = np.zeros(len(key), bool)
            seen[by[1:]] = key[by[1:]] == key[by[:-1]]
            where = line_of[:-2][ok]
            self.triples, self.repeats = np.bincount(where, minlength=n), np.bincount(where[seen], minlength=n)
        stripped = [x.strip() or b" " for x in lines]
        self.last = _EDGE[1][np.frombuffer(b"".join(x[-1:] for x in stripped), np.uint8)] if n else np.zeros(0, np.uint8)
        first = _EDGE[0][np.frombuffer(b"".join(x[:1] for x in stripped), np.uint8)] if n else np.zeros(0, np.uint8)
        some = np.maximum(self.words, 1)
        values = {
            "chars": self.chars, "common": self.common / some, "symbols": self.symbols / filled, "digits": self.digits / filled, "mean_word": (self.letters + self.digits) / some, "max_word": longest,
            "repeated": self.repeats / np.maximum(self.triples, 1), "separators": count(separator) / some, "words": self.words, "gaps": count(gap),
        }
        self.bins = np.stack([*(np.digitize(values[k], b) for k, b in _BINS.items()), first, self.last], axis=1) if n else np.zeros((0, len(_SIZES)), np.int64)
        self._begin()

    @classmethod
    def of(cls, bins: np.ndarray, doc: np.ndarray, filled: np.ndarray) -> "Lines":
        """Lines of which only what fitting needs is known."""
        out = object.__new__(cls)
        out.bins, out.doc, out.filled = bins, doc, filled
        out._begin()
        return out

    def _begin(self) -> None:
        self.starts = np.flatnonzero(np.concatenate([[True], self.doc[1:] != self.doc[:-1]])) if len(self.doc) else np.zeros(0, np.int64)

    def subset(self, keep: np.ndarray) -> "Lines":
        out = copy.copy(self)
        for name in ("doc", "bins"):
            setattr(out, name, getattr(self, name)[keep])
        out._begin()
        return out


class Model:
    """Log-probabilities: first[state], move[state, state], emit[feature][bin, state]; _LABEL gives a state's form."""

    def __init__(self):
        k = len(_LABEL)
        self.first = np.full(k, -np.log(k))
        self.move = np.full((k, k), -np.log(k))
        self.emit = [np.zeros((s, k)) for s in _SIZES]

    def scores(self, x: Lines) -> np.ndarray:
        out = np.zeros((len(x.bins), len(_LABEL)))
        for f, table in enumerate(self.emit):
            out += table[x.bins[:, f]]
        return 0.5 * out  # the statistics are not independent: a line must not outweigh all others

    def path(self, x: Lines, lean: np.ndarray | None = None) -> np.ndarray:
        """The most probable states, all documents at once, line by line."""
        e = self.scores(x).astype(np.float32)
        if lean is not None:
            e += lean.astype(np.float32)
        move = self.move.astype(np.float32).T.copy()  # [to, from]: the sums run along the last axis
        n = len(e)
        if not n:
            return np.zeros(0, np.int64)
        length = np.diff(np.append(x.starts, n))
        by = np.argsort(-length, kind="stable")
        start, length = x.starts[by], length[by]
        longer = np.searchsorted(-length, -np.arange(length[0]), "left")  # documents longer than t lines
        begin = np.concatenate([[0], np.cumsum(longer)])
        # first lines first, then second ones, ...: each step reads and writes a slice
        at = np.concatenate([start[:m] + t for t, m in enumerate(longer)])
        k = len(_LABEL)
        back = np.zeros((n, k), np.int8)
        best = e[at]
        best[: longer[0]] += self.first
        most = longer[1] if len(longer) > 1 else 0
        via_, row = np.empty((most, k, k), np.float32), np.arange(most * k) * k
        for t, m in enumerate(longer[1:], 1):
            via, here = via_[:m], slice(begin[t], begin[t + 1])
            np.add(best[begin[t - 1] : begin[t - 1] + m, None, :], move, out=via)
            came = via.argmax(2)
            back[here] = came
            best[here] += via.reshape(-1)[row[: m * k] + came.reshape(-1)].reshape(m, k)
        state = np.zeros(n, np.int64)
        last = begin[length - 1] + np.arange(len(length))
        state[last] = best[last].argmax(1)
        for t in range(length[0] - 1, 0, -1):
            here = np.arange(begin[t], begin[t + 1])
            state[begin[t - 1] : begin[t - 1] + len(here)] = back[here, state[here]]
        out = np.empty(n, np.int64)
        out[at] = state
        return out

    def fit(self, x: Lines, states: np.ndarray) -> None:
        k = len(_LABEL)
        for f, size in enumerate(_SIZES):
            counts = np.full((size, k), 0.3)
            np.add.at(counts, (x.bins[:, f], states), 1.0)
            self.emit[f] = np.log(counts / counts.sum(0))
        first = np.full(k, 0.5)
        np.add.at(first, states[x.starts], 1.0)
        self.first = np.log(first / first.sum())
        inner = np.ones(len(states), bool)
        inner[x.starts] = False
        at = np.flatnonzero(inner)
        moves = np.full((k, k), 0.1) + np.eye(k) + 0.2 * (_LABEL[:, None] == _LABEL)
        np.add.at(moves, (states[at - 1], states[at]), 1.0)
        self.move = np.log(moves / moves.sum(1, keepdims=True))


def kinds(x: Lines, form: np.ndarray, rounds: int = 8) -> np.ndarray:
    """First states: the lines of each form in as many clusters of binned statistics, seeded by the farthest lines."""
    state = np.zeros(len(form), np.int64)
    for f, (name, k) in enumerate(_KINDS.items()):
        at = np.flatnonzero(form == f)
        if not len(at):
            continue
        rows, count = np.unique(x.bins[at], axis=0, return_counts=True)
        apart = lambda c: (rows[:, None, :] != c[None]).sum(2)
        centres = rows[[count.argmax()]]
        while len(centres) < min(k, len(rows)):
            centres = np.vstack([centres, rows[(apart(centres).min(1) * np.log1p(count)).argmax()]])
        for _ in range(rounds):
            own = apart(centres).argmin(1)
            for c in range(len(centres)):
                if (own == c).any():
                    centres[c] = [np.bincount(column, count[own == c]).argmax() for column in rows[own == c].T]
        state[at] = apart_own(x.bins[at], centres) + np.flatnonzero(f == _LABEL)[0]
    return state


def apart_own(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre that differs from each row in the fewest statistics."""
    return np.stack([(rows != c).sum(1) for c in centres], axis=1).argmin(1)


def _fitted(x: Lines, label_of_doc: np.ndarray, lines: np.ndarray, rounds: int) -> Model:
    """A model of the lines chosen (whole documents)."""
    model, part = Model(), x.subset(lines)
    if len(part.doc):
        form = label_of_doc[part.doc]
        # the bullets of a prose document are list lines: it is prose by what stands between them
        form = np.where((form == 0) & np.isin(part.bins[:, len(_BINS)], (1, 3)), 1, form)
        model.fit(part, kinds(part, form))
        lean = np.where(form[:, None] == _LABEL, 0.0, np.log(0.05))
        for _ in range(rounds):
            model.fit(part, model.path(part, lean))
    return model


def made_up(pool: set[str], sentences: set[str], n: int = 12, seed: int = 7) -> list[tuple[str, str]]:
    """(text, label) of invented lists, tables and junk from words and sentences of labelled texts: kinds that few labels may lack.

    Word salad, one sentence over and over, damaged characters, random bytes, keywords, log lines and
    code; bullets, numbers, boxes, leaders, times; tables by bars, commas, tabs and columns.
    """
    rng = random.Random(seed)
    pool, sentences = sorted(pool), sorted(sentences)
    if len(pool) < 20 or not sentences:
        return []
    word = lambda: rng.choice(pool)
    words_ = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    number = lambda: rng.choice([str(rng.randint(1, 400)), f"{rng.random() * 5:.2f}", "n/a", "-", "A", "B+"])
    lines = lambda f: "\n".join(f(k) for k in range(1, rng.randint(5, 14)))
    hexes = lambda k: f"{rng.getrandbits(4 * k):0{k}x}"
    damaged = lambda x: "".join(c if rng.random() > 0.25 else rng.choice("|{}^~*;:1§") for c in x)
    cells = lambda: [words_(1, 2), *(number() for _ in range(rng.randint(2, 5)))]
    makers = {
        "junk": [
            lambda: lines(lambda k: words_(6, 14).capitalize() + "."), lambda: (rng.choice(sentences) + ". ") * rng.randint(6, 25), lambda: (rng.choice([word(), "and", "la", "ok"]) + " ") * rng.randint(25, 90),
            lambda: lines(lambda k: damaged(rng.choice(sentences))), lambda: base64.encodebytes(rng.randbytes(rng.randint(150, 500))).decode(), lambda: ", ".join(rng.choices([words_(1, 2) for _ in range(5)], k=rng.randint(10, 30))),
            lambda: lines(lambda k: f"{rng.choice(['', '2024-05-0' + str(k % 9) + ' '])}{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02} {rng.choice(['INFO', 'WARN', 'DEBUG', 'ERROR'])} {word()}.{word()} {hexes(8)} {word()}={rng.randint(1, 900)}"),
            lambda: lines(lambda k: rng.choice([f"{word()} = {word()}({rng.randint(0, 99)}, {word()}.{word()});", f"if ({word()}[{k}] > {rng.randint(0, 99)}) {{ return !{word()}; }}", f"def {word()}({word()}): return {{'{word()}': {k}}}", f'<div class="{word()}" id={word()}{k}><b>{word()}</b></div>'])), *[lambda: rng.choice([",", "=-", ".", "_*", "#"]) * rng.randint(3, 120)] * 4,
            *[lambda: (rng.choice(sentences).rstrip(".") + ". ") * rng.randint(4, 25)] * 5,
        ],
        "list": [
            lambda: lines(lambda k: f"- {words_(1, 3)}"), lambda: lines(lambda k: f"{k}. {words_(1, 2)}: {words_(1, 2)}"), lambda: lines(lambda k: f"[{rng.choice(' x')}] {words_(1, 4)}"), lambda: lines(lambda k: f"* {words_(2, 3)} ({k})"),
            lambda: lines(lambda k: f"{words_(1, 2)} .......... {rng.randint(1, 300)}"), lambda: lines(lambda k: f"{words_(1, 2).capitalize()} ({words_(1, 2)})"), lambda: lines(lambda k: f"{rng.randint(7, 19)}:{rng.choice(['00', '15', '30', '45'])} {words_(1, 2)} - the {words_(1, 2)}"),
        ],
        "table": [
            lambda: lines(lambda k: "| " + " | ".join(cells()) + " |"), lambda: lines(lambda k: ",".join(cells())), lambda: lines(lambda k: "\t".join(cells())), lambda: lines(lambda k: ";".join(f'"{c}"' for c in cells())),
            lambda: lines(lambda k: "".join(f"{c:<{18 if i == 0 else 9}}" for i, c in enumerate(cells()))),
        ],
    }
    return [(make(), label) for label, kinds_ in makers.items() for make in kinds_ for _ in range(n)]


def excerpts(text: str, n_words: int = 12) -> tuple[list[str], list[str]]:
    """Some words and a sentence of a text: a bounded share of any."""
    rng = random.Random(len(text))
    words_ = sorted({w for w in text.split() if w.isalpha() and 3 < len(w) < 30 and w.lower() not in _FUNCTION_WORDS})
    sentences = [x.strip() for x in text.replace("\n", " ").split(". ") if 5 <= len(x.split()) <= 30 and len(x) < 300]
    return rng.sample(words_, min(n_words, len(words_))), rng.sample(sentences, min(1, len(sentences)))


def train(x: Lines, label_of_doc: np.ndarray, sure: np.ndarray | None = None, rounds: int = 3) -> Model:
    """Fits twice: the second time without the documents that the first model contradicts, as raters err; not so the sure ones."""
    every = np.ones(len(x.doc), bool)
    model = _fitted(x, label_of_doc, every, rounds)
    if not len(x.doc):
        return model
    own = _LABEL[model.path(x)] == label_of_doc[x.doc]
    share = np.bincount(x.doc, x.filled * own, minlength=len(label_of_doc)) / np.maximum(np.bincount(x.doc, x.filled, minlength=len(label_of_doc)), 1)
    kept = share >= 0.3 if sure is None else (share >= 0.3) | sure
    return _fitted(x, label_of_doc, kept[x.doc], rounds)


def _body(texts: list[bytes], marks: list, frames: boilerplate.Frames | None) -> Lines:
    """Lines outside the frame. marks: whether each text is from the web, or (without frames) its frame line numbers."""
    if frames is None:
        dropped = [set(m or ()) for m in marks]
    else:
        s = boilerplate.Stream(texts)
        keep = frames.lines(s, np.array(marks, bool), *boilerplate.SHARES)
        dropped = [set() for _ in texts]
        for d, n in zip(s.doc[s.begin[keep]].tolist(), s.line[s.begin[keep]].tolist()):
            dropped[d].add(n)
    lines, doc = [], []
    for d, t in enumerate(texts):
        body = [line for n, line in enumerate(t.split(b"\n"), 1) if line and n not in dropped[d] and not line.isspace()]
        if len(t) > _LONG and max(map(len, body), default=0) > _LONG:  # a paragraph on one line is read sentence by sentence
            body = [x for line in body for x in (line.replace(b". ", b".\n").split(b"\n") if len(line) > _LONG else (line,)) if x and not x.isspace()]
        lines += body
        doc += [d] * len(body)
    return Lines(lines, np.array(doc, np.int64))


_SCHEMA = "doc_id long, n_chars long, n_words long, mean_word_length double, symbol_ratio double, end_punctuation_share double, common_word_share double, n_body_lines long, prose_share double, list_share double, table_share double, junk_share double"


def _chunks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[Iterator[tuple]]:
    """The columns of rows whose texts, which come second, are bounded in total."""
    held, size = [], 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in names)):
            held.append(row)
            size += len(row[1] or "")
            if size >= _CHUNK:
                yield zip(*held)
                held, size = [], 0
    if held:
        yield zip(*held)


def _rate(model_, repeats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frames = model_.value, repeats and boilerplate.Frames(repeats.value)
        names = [c.split()[0] for c in _SCHEMA.split(", ")]

        def rows(ids: tuple, texts: list[bytes], marks: tuple, sizes: list[int]) -> pa.RecordBatch:
            x = _body(texts, marks, frames)
            state = _LABEL[model.path(x)]
            n = len(ids)
            total = lambda v: np.bincount(x.doc, v, minlength=n)
            chars = x.filled
            words_, lines = total(x.words), total(np.ones(len(x.doc)))
            filled = total(chars)
            shares = [total(np.where(state == k, chars, 0)) for k in range(len(STATES))]
            over = lambda a, b: a / np.maximum(b, 1)
            empty = filled == 0
            out = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(words_.astype(np.int64)), pa.array(over(total(x.letters + x.digits), words_)), pa.array(over(total(x.symbols), filled)), pa.array(over(total(x.last == 1), lines)), pa.array(over(total(x.common), words_)), pa.array(lines.astype(np.int64))]
            return pa.RecordBatch.from_arrays([*out, *(pa.array(over(s, filled), mask=empty) for s in shares)], names)

        for ids, texts, marks in _chunks(batches, ("doc_id", "text", "mark")):
            yield rows(ids, [boilerplate.fold(t or "") for t in texts], marks, [len((t or "").strip()) for t in texts])

    return run


def labelled(labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, label): majority labels of at most max_labelled documents."""
    form = F.lower(F.trim("form"))
    votes = labels.where(form.isin(*STATES) & F.col("doc_id").isNotNull()).groupBy("doc_id", form.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("doc_id").agg(F.max_by("label", "n").alias("label"), F.max("n").alias("n"), F.collect_list("n").alias("all"))
    clear = best.where(F.size(F.filter("all", lambda v: v == F.col("n"))) == 1)
    return clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id", "label")


def _line_statistics(repeats):
    """The binned statistics of each labelled text's main-body lines, their sizes, and excerpts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = repeats and boilerplate.Frames(repeats.value)
        for ids, texts, marks, labels in _chunks(batches, ("doc_id", "text", "mark", "label")):
            x = _body([boilerplate.fold(t or "") for t in texts], marks, frames)
            cuts = np.searchsorted(x.doc, np.arange(len(texts) + 1))
            bins, filled = x.bins.astype(np.uint8), x.filled.astype(np.int32)
            parts = [(bins[a:e].tobytes(), filled[a:e].tobytes()) for a, e in zip(cuts[:-1], cuts[1:])]
            columns = [ids, labels, *zip(*parts), *zip(*(excerpts(t or "") for t in texts))]
            kinds_ = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_)], ["doc_id", "label", "bins", "filled", "words", "sentences"])

    return run


def fit(documents: DataFrame, labels: DataFrame, repeats, max_labelled: int, invented: bool = True) -> Model:
    """documents: (doc_id, text, mark). repeats: the broadcast frame hashes, or None where mark has the frame lines."""
    chosen = labelled(labels, max_labelled)  # at most max_labelled rows
    sample = documents.join(F.broadcast(chosen), "doc_id").where(F.length(F.trim("text")) > 0).select("doc_id", "text", "mark", "label")
    rows = sample.mapInArrow(_line_statistics(repeats), "doc_id long, label string, bins binary, filled binary, words array<string>, sentences array<string>").collect()
    rows = sorted({r.doc_id: r for r in sorted(rows, key=lambda r: bytes(r.bins))}.values(), key=lambda r: r.doc_id)
    extra = made_up({w for r in rows for w in r.words}, {x for r in rows for x in r.sentences}) if invented else []
    more = _body([boilerplate.fold(t) for t, _ in extra], [None for _ in extra], None)
    bins = [np.frombuffer(r.bins, np.uint8).reshape(-1, len(_SIZES)).astype(np.int64) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in bins])
    filled = [np.frombuffer(r.filled, np.int32).astype(np.int64) for r in rows]
    x = Lines.of(np.concatenate([np.zeros((0, len(_SIZES)), np.int64), *bins, more.bins]), np.concatenate([doc, more.doc + len(rows)]), np.concatenate([np.zeros(0, np.int64), *filled, more.filled]))
    form = [STATES.index(label) for label in [*(r.label for r in rows), *(label for _, label in extra)]]
    return train(x, np.array(form, np.int64), np.arange(len(form)) >= len(rows))


def prose_shares(documents: DataFrame, labels: DataFrame, *, max_labelled: int = 4000) -> DataFrame:
    """Like text_quality, of whole texts: page frames are not taken out, so nothing is known of the corpus but the labels."""
    ship(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("array<int>").alias("mark"))
    model = fit(docs, labels, None, max_labelled)
    return docs.mapInArrow(_rate(documents.sparkSession.sparkContext.broadcast(model), None), _SCHEMA)


def text_quality(documents: DataFrame, labels: DataFrame, *, max_labelled: int = 4000, block: int = 4_000_000) -> DataFrame:
    """Statistics and label shares of every document's main body (columns: _SCHEMA).

    Up to `block` frame repeats go to the workers at once, so that a text is read once; with more, the
    frame lines are found block by block and joined to the documents.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", boilerplate.host(F.col("url")).isNotNull().alias("mark"))
    repeats = materialise(boilerplate.frame_repeats(documents).select("h"), "repeats")
    if repeats.count() <= block:
        shared = spark.sparkContext.broadcast(repeats.toPandas()["h"].to_numpy(np.int64).tobytes())
    else:
        shared = None
        texts = docs.select(F.lit("documents").alias("record_table"), F.col("doc_id").alias("record_id"), F.col("mark").alias("web"), "text")
        found = boilerplate.frame_lines(texts, repeats, bound=block).groupBy(F.col("record_id").alias("doc_id")).agg(F.collect_set("line_no").alias("mark"))
        docs = materialise(docs.drop("mark").join(found, "doc_id", "left"), "bodies")
    model = fit(docs, labels, shared, max_labelled)
    return docs.mapInArrow(_rate(spark.sparkContext.broadcast(model), shared), _SCHEMA)


def not_prose(quality: DataFrame, least_prose: float = 0.5) -> DataFrame:
    """doc_id of the documents whose main body is not natural prose."""
    return quality.where((F.col("n_chars") >= 3) & (F.col("prose_share") < least_prose)).select("doc_id")
