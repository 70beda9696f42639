"""Noise in text from scanned pages.

Method: words of scanned texts that clean texts don't have get correction candidates by inverted lists of the character
q-grams of their shapes; gradient boosting, trained on words spoilt on purpose, ranks the candidates and chooses a
replacement or none. Every known word that shares a gram is a candidate. Line-pair classifiers (bagged trees on weak labels) tell page furniture from text, and words cut at
line ends from compounds with a hyphen of their own.

Scale: texts are read twice, once to count words and to label lines and once to find defects, and never shuffled; what a
pass finds is written once and read by all that follows. Word counts are combined in each batch and again before
their shuffle. Only a candidate of the word's own shape can be accepted, so these are ranked first, by a join on the shape;
all others only matter where they rank higher. They meet in cells of LEFT by RIGHT words, in which inverted lists of grams
give the pairs, so no gram is hot, and a pair is dropped as soon as the trees left can't lift it above the word's own.
What is broadcast: the models, and corrections only below a checked size. Models are fitted on at most TRAIN_ROWS rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestack.llm.names import plain, slips
from lorestack.llm.trees import Bagged, Boosted
from lorestack.session import cut, lookup_join
from lorestack.sources.tables import table

TRAIN_ROWS = 6000

#: A clean text with a word speaks as strongly for it as so many scanned ones.
CLEAN_WEIGHT = 25

#: Wrong candidates shown for each word that the ranking is fitted on, those with the most grams in common.
NEGATIVES = 3

#: Words of a cell, in which suspicious words meet known ones, and pairs worked on at once.
LEFT, RIGHT, PAIRS = 512, 4096, 1 << 15

#: From so many slips on all count as this many.
SLIPS = 5

# What scanners take for what. The right side is the common shape of both.
WIDE = (("nn", "rm"), ("h", "li"), ("b", "li"), ("m", "rn"), ("w", "vv"), ("d", "cl"), ("u", "ii"), ("n", "ri"))
NARROW = str.maketrans({"1": "l", "!": "l", "|": "l", "i": "l", "j": "l", "0": "o", "@": "a", "9": "g", "q": "g", "5": "s", "$": "s", "e": "c", "t": "f", "7": "f", "2": "z"})
SPOILS = (("nn", "rm"), ("li", "h"), ("m", "rn"), ("w", "vv"), ("d", "cl"), ("u", "ii"), ("ri", "n"), ("i", "!"), ("l", "1"), ("o", "0"), ("a", "@"), ("g", "9"), ("s", "5"), ("h", "b"), ("e", "c"), ("t", "f"), ("T", "7"), ("i", "l"), ("b", "8"))
_PARTS = re.compile(r"[-‐‑–—/'’]")
STRAYS = set("|\\¦^~_`*°¬«»<>#=+")
HYPHENS = "-¬­‐‑"

WORD = re.compile(r"[A-Za-zÀ-ÿ0-9@!$|]+\Z")
NUMBER = r"[\[(\-–— ]*(?:page\s+|p\.\s*)?([0-9OolIi|!@gGsSbBzZ]{1,5}|[ivxlcIVXLC1!|]{1,8})(?:\s*(?:of|/|oj|0f)\s*[0-9OolI|!gGsSbB@]{1,5})?[\])\-–— .]*"
ONLY_NUMBER = re.compile(NUMBER + r"\Z", re.I)
LIKE_PAGE = re.compile(r"\s*[PFRp][a@]?[gq9]?[ec]?\s+[0-9OolI|!gGsSbB@]{1,5}\s+[o0][ft]\s+[0-9OolI|!gGsSbB@]{1,5}\s*\Z")
NUMBER_FIRST = re.compile(r"([0-9OolI|!gGsSbB@]{1,5}|[ivxlc1!|]{1,8})(?:\s{2,}|\s*[·•|]\s+)(\S.*)\Z")
NUMBER_LAST = re.compile(r"(.*\S)(?:\s{2,}|\s*[·•|]\s+)([0-9OolI|!gGsSbB@]{1,5}|[ivxlc1!|]{1,8})\Z")
ENDED = re.compile(r"[.!?:;|)\]\"”»]\Z")


@lru_cache(maxsize=1 << 17)
def shape(word: str) -> str:
    """What is left of a word when everything that scanners confuse is the same."""
    word = word.lower().replace("7", "t").replace("8", "b").replace("6", "b")
    for letter, wide in WIDE:
        word = word.replace(letter, wide)
    return plain(word).translate(NARROW)


def grams(word: str) -> list[str]:
    padded = f"^{shape(word)}$"
    return sorted({padded[i : i + 3] for i in range(len(padded) - 2)})


@lru_cache(maxsize=1 << 17)
def parts_of(token: str) -> list[str]:
    """The words of a token: without outer punctuation, cut at hyphens."""
    token = token.strip(".,;:()[]{}\"“”„'’‘?…»«*_").rstrip("!")
    return [p for p in _PARTS.split(token) if p and WORD.match(p) and any(c.isalpha() for c in p)]


def number_value(text: str) -> int | None:
    """The page number that a text stands for."""
    folded = text.translate(str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "g": "9", "G": "6", "s": "5", "S": "5", "b": "6", "B": "8", "z": "2", "Z": "2", "@": "0"}))
    if folded.isdigit() and any(c.isdigit() for c in text):
        return int(folded)
    roman = text.lower().replace("1", "i").replace("!", "i").replace("|", "i")
    if roman and all(c in "ivxlc" for c in roman):
        values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in roman]
        return sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0]))
    return None


LINE_FEATURES = ("only_number", "edge_number", "in_sequence", "repeats", "title", "upper", "breaks_flow", "blank_before", "blank_after", "first_line", "last_line", "fill", "words", "ended", "lower_start", "spread")


@dataclass
class Page:
    """A text by lines, and what was found out about them."""

    lines: list[str]
    raw: list[str]
    width: int = 0
    scanned: bool = False
    candidates: list[int] = field(default_factory=list)
    features: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LINE_FEATURES))))
    labels: list[int] = field(default_factory=list)


def read_page(text: str, title: str | None) -> Page:
    raw = text.split("\n")
    lines = [line.rstrip("\r \t") for line in raw]
    page = Page(lines, raw)
    full = [i for i, x in enumerate(lines) if x.strip()]
    if len(full) < 4:
        return page
    lengths = sorted(len(lines[i]) for i in full)
    page.width = lengths[min(len(lengths) - 1, int(0.97 * len(lengths)))]
    pairs = [(i, i + 1) for i in full if i + 1 < len(lines) and lines[i + 1].strip() and not ENDED.search(lines[i])]
    fits = sum(len(lines[i]) + 1 + len(lines[j].split()[0]) > page.width - 4 for i, j in pairs)
    flowing = sum(lines[j].lstrip()[:1].islower() for _, j in pairs)
    page.scanned = 36 <= page.width <= 110 and len(pairs) >= 2 and fits >= 0.6 * len(pairs) and flowing >= 0.4 * len(pairs) and len(pairs) >= 0.25 * len(full)
    if page.scanned:
        _furniture(page, full, title)
    return page


def _head(line: str) -> tuple[str, int | None]:
    """(text of a line without its page number, the number)."""
    x = line.strip()
    if len(x) <= 24 and (m := ONLY_NUMBER.match(x)):
        value = number_value(m.group(1))
        if value is not None:
            return "", value
    for pattern, text, number in ((NUMBER_FIRST, 2, 1), (NUMBER_LAST, 1, 2)):
        if (m := pattern.match(x)) and (value := number_value(m.group(number))) is not None:
            return m.group(text), value
    return x, None


class Alike:
    """Finds the commonest of some strings that is at most three slips from another one.

    A dozen are compared one by one. More are found by their quarters: with a sign left out between two of them no slip, not
    even a swap, spoils two, so one of the four is left, moved by three signs at most.
    """

    def __init__(self, strings: list[tuple[str, int]]):
        self.strings = strings  # commonest first
        self.short, self.quarters = [], {}
        if len(strings) > 12:
            for k, (x, _) in enumerate(strings):
                if len(x) < 7:
                    self.short.append(k)
                    continue
                for q, (a, b) in enumerate(self.cuts(len(x))):
                    self.quarters.setdefault((len(x), q, x[a:b]), []).append(k)
        self.lengths = sorted({n for n, _, _ in self.quarters})

    @staticmethod
    @lru_cache(maxsize=1 << 12)
    def cuts(length: int) -> list[tuple[int, int]]:
        ends = [(length - 3) * q // 4 for q in range(5)]
        return [(a + q, b + q) for q, (a, b) in enumerate(zip(ends, ends[1:]))]

    def count(self, own: str) -> int:
        """How often the commonest one alike occurs; 0 if none is."""
        found = range(len(self.strings))
        if self.quarters or self.short:
            found = set(self.short if len(own) <= 9 else ())  # they have six signs at most
            for n in self.lengths:
                if abs(n - len(own)) <= 3:
                    for q, (a, b) in enumerate(self.cuts(n)):
                        for move in range(max(-3, -a), 4):
                            found.update(self.quarters.get((n, q, own[a + move : b + move]), ()))
        return next((self.strings[k][1] for k in sorted(found) if slips(self.strings[k][0], own, 3) <= 3), 0)


def _furniture(page: Page, full: list[int], title: str | None) -> None:
    """Features and weak labels of the lines that may be furniture. Linear in the lines of the page."""
    heads = {i: _head(page.lines[i]) for i in full}
    shapes = {i: shape(re.sub(r"\W+", " ", heads[i][0]).strip()) for i in full}
    counts = Counter(x for x in shapes.values() if len(x) > 4)
    common = Alike([(x, n) for x, n in counts.most_common() if n > 1])
    name = shape(re.sub(r"\W+", " ", title or "").strip())
    numbers = [(i, heads[i][1]) for i in full if heads[i][1] is not None]
    last = {n: i for i, n in numbers}
    first = {n: i for i, n in reversed(numbers)}
    near = {i: any(last.get(n + d, -1) > i or first.get(n - d, i) < i for d in (1, 2)) for i, n in numbers}
    rows = []
    for k, i in enumerate(full):
        x, number, own = heads[i][0], heads[i][1], shapes[i]
        line = page.lines[i].strip()
        again = counts[own] if len(own) > 4 else 0
        if again < 2 and len(own) > 6:
            again = common.count(own) or again
        titled = bool(name) and len(own) > 6 and (own == name or abs(len(name) - len(own)) <= 3 and slips(name, own, 3) <= 3)
        page_like = bool(LIKE_PAGE.match(line))
        if number is None and again < 2 and not titled and not page_like:
            continue
        before = page.lines[full[k - 1]].strip() if k else ""
        after = page.lines[full[k + 1]].strip() if k + 1 < len(full) else ""
        breaks = bool(before) and not ENDED.search(before) and after[:1].islower()
        letters = [c for c in x if c.isalpha()]
        upper = sum(c.isupper() for c in letters) / max(1, len(letters))
        spread = bool(re.search(r"\S\s{2,}\S|[·•]", line))
        row = [
            float(not x or page_like), float(number is not None and bool(x)), float(near.get(i, False)), float(again), float(titled), upper if len(letters) > 3 else 0.0, float(breaks),
            float(i > 0 and not page.lines[i - 1].strip()), float(i + 1 < len(page.lines) and not page.lines[i + 1].strip()), float(k == 0), float(k + 1 == len(full)),
            len(line) / max(1, page.width), float(len(line.split())), float(bool(ENDED.search(line))), float(line[:1].islower()), float(spread),
        ]
        label = -1
        edge, dressed = row[9] or row[10], bool(re.match(r"[-–—\[(]\s*\w+\s*[-–—\])]\Z", line))
        if page_like or row[0] and (row[2] or breaks or edge or dressed) or number is not None and x and spread and (len(line.split()) < 8 or upper > 0.9 or again > 1 or titled) or again > 1 and titled or again > 1 and upper > 0.9 and len(letters) > 6:
            label = 1
        elif line[:1].islower() and again < 2 and not row[0] or not spread and again < 2 and not titled and len(line.split()) > 5 or ENDED.search(line) and again < 2 and x:
            label = 0
        page.candidates.append(i)
        rows.append(row)
        page.labels.append(label)
    page.features = np.array(rows).reshape(-1, len(LINE_FEATURES))


def split_ends(page: Page, furniture: set[int]) -> list[tuple[int, int, str, str, int, bool]]:
    """(line, next line or -1, left token, right token, kind of hyphen, right starts lower) of lines that end in a hyphen."""
    text = [i for i, x in enumerate(page.lines) if x.strip() and i not in furniture]
    out = []
    for k, i in enumerate(text):
        line = page.lines[i]
        if line[-1:] in HYPHENS and len(line) > 2 and line[-2].isalpha():
            left = line.split()[-1].rstrip(HYPHENS)
            j = text[k + 1] if k + 1 < len(text) else -1
            right = page.lines[j].split()[0] if j >= 0 else ""
            kind = 2 if line[-1] == "¬" else 3 if line[-1] == "­" else 1 if page.raw[i].rstrip("\r")[-1:] in " \t" else 0
            out.append((i, j, left, right, kind, right[:1].islower()))
    return out


def joined(left: str, right: str) -> tuple[str, str, str, str]:
    """(the word as one, as a compound, its left end, its right start), lower case."""
    a, b = left.lower().lstrip("(\"'“„[«"), right.lower().rstrip(".,;:()[]\"“”'’?!…»")
    last, first = re.split(r"[-‐‑–—]", a)[-1], re.split(r"[-‐‑–—'’]", b)[0]
    return last + first, f"{a}-{b}", last, first


def _texts(sources: DataFrame) -> DataFrame:
    return sources.filter("id is not null and length(text) > 0").select("id", "title", "text")


def survey(sources: DataFrame) -> DataFrame:
    """What one pass over the texts finds, as rows of two kinds: (word, clean, scanned, cut) counts of a batch, where a word put
    together at a line end counts as cut, and (x, label) of lines that may be furniture."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, scanned, cuts = Counter(), Counter(), Counter()
            x, labels = [], []
            for text, title in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                page = read_page(text, title)
                if not page.scanned:
                    tokens = set(text.split())
                    clean.update({p.lower() for t in tokens for p in parts_of(t)} | {t.lower().strip(".,;:()[]\"?!") for t in tokens if "-" in t})
                    continue
                x.extend(page.features.tolist())
                labels.extend(page.labels)
                skip = {i for i, label in zip(page.candidates, page.labels) if label == 1}
                ends = split_ends(page, skip)
                cuts.update(joined(e[2], e[3])[0] for e in ends if e[3])
                drop_last, drop_first = {e[0] for e in ends}, {e[1] for e in ends}
                tokens = set()
                for i, line in enumerate(page.lines):
                    if i not in skip:
                        tokens.update(line.split()[1 if i in drop_first else 0 : -1 if i in drop_last else None])
                scanned.update({p.lower() for t in tokens for p in parts_of(t)})
            words, blank = sorted({*clean, *scanned, *cuts}), [None] * len(labels)
            columns = [
                pa.array(words + blank, pa.string()), *(pa.array([c[w] for w in words] + blank, pa.int64()) for c in (clean, scanned, cuts)),
                pa.array([None] * len(words) + x, pa.list_(pa.float64())), pa.array([None] * len(words) + labels, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["word", "clean", "scanned", "cut", "x", "label"])

    return sources.select("title", "text").mapInArrow(count, "word string, clean long, scanned long, cut long, x array<double>, label int")


def word_counts(surveyed: DataFrame) -> DataFrame:
    """(word, clean, scanned, cut): texts with the word, by kind, and words put together at line ends of scanned texts."""
    return surveyed.filter("word is not null").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned"), F.sum("cut").alias("cut"))


def pair_features(word: str, right: str, known: float) -> list[float]:
    """Of a suspicious word and a candidate known in `known` texts."""
    a, b = shape(word), shape(right)
    x, y = set(grams(word)), set(grams(right))
    odd = any(not c.isalpha() for c in word)
    return [float(a == b), float(min(SLIPS, slips(word, right, SLIPS - 1))), float(min(SLIPS, slips(a, b, SLIPS - 1))), len(x & y) / max(1, len(x | y)), float(len(right)), float(odd), float(word[:1] == right[:1]), float(word[-1:] == right[-1:]), float(np.log1p(known)), float(len(word) - len(right))]


def gram_lists(words: list[str]) -> dict[str, np.ndarray]:
    """Which words, by their places, have a gram."""
    lists: dict[str, list[int]] = {}
    for k, w in enumerate(words):
        for g in grams(w):
            lists.setdefault(g, []).append(k)
    return {g: np.array(x) for g, x in lists.items()}


def shared_grams(word: str, lists: dict[str, np.ndarray], size: int) -> np.ndarray:
    """How many grams each of the words behind the lists shares with a word."""
    found = [lists[g] for g in grams(word) if g in lists]
    return np.bincount(np.concatenate(found), minlength=size) if found else np.zeros(size, int)


def fit_ranker(words: list[tuple[str, int]], seed: int = 3) -> Boosted:
    """Trained on known words spoilt as scanners do (the word itself is right, its neighbours are wrong), and on known
    words taken for unknown ones, for which every neighbour is wrong."""
    rng = np.random.default_rng(seed)
    known = dict(words)
    order = sorted(known)
    lists = gram_lists(order)

    def near(word: str) -> list[str]:
        n = shared_grams(word, lists, len(order))
        rank = n * len(order) - np.arange(len(order))  # no ties
        top = np.argsort(-rank)[: NEGATIVES + 1] if len(order) <= NEGATIVES + 1 else np.argpartition(-rank, NEGATIVES)[: NEGATIVES + 1]
        return [order[k] for k in sorted(top, key=lambda k: -rank[k]) if n[k] and order[k] != word][:NEGATIVES]

    x, y = [], []
    for w in order:
        if len(w) < 3:
            continue
        fits = [(a, b) for a, b in SPOILS if a in w]
        if fits:
            a, b = fits[rng.integers(len(fits))]
            places = [m.start() for m in re.finditer(re.escape(a), w)]
            p = places[rng.integers(len(places))]
            spoilt = w[:p] + b + w[p + len(a) :]
            if spoilt not in known:
                x.append(pair_features(spoilt, w, known[w]))
                y.append(1)
                for c in near(spoilt):
                    if c != w:
                        x.append(pair_features(spoilt, c, known[c]))
                        y.append(0)
        for c in near(w):
            if shape(c) != shape(w):
                x.append(pair_features(w, c, known[c]))
                y.append(0)
    return Boosted.fit(np.array(x).reshape(-1, 10), np.array(y, dtype=float))


def slips_many(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """min(SLIPS, slips) of pairs of words in the rows of two arrays of characters, of lengths n and m.

    Cells of the table further than SLIPS - 1 from its diagonal hold at least SLIPS, so only those nearer are worked out."""
    reach, out = SLIPS - 1, np.full(len(n), SLIPS, np.int8)
    rows = np.flatnonzero(abs(n - m) <= reach)
    rows = rows[np.argsort(-n[rows], kind="stable")]  # longest first: those done leave at the end
    if not len(rows):
        return out
    n, m = n[rows], m[rows]
    a, b = np.ascontiguousarray(a[rows, : n.max()].T), np.ascontiguousarray(b[rows, : m.max()].T)
    far = np.full(len(rows), SLIPS, np.int8)
    two, one = [far] * (2 * reach + 1), [far if d < 0 else np.full(len(rows), d, np.int8) for d in range(-reach, reach + 1)]
    result = np.zeros(len(rows), np.int8)
    for i in range(1, len(a) + 1):
        live = int(np.searchsorted(-n, -i, side="right"))
        row = []
        for k in range(2 * reach + 1):
            j = i + k - reach
            if j <= 0 or j > len(b):
                row.append(np.full(live, i, np.int8) if j == 0 else far[:live])
                continue
            best = one[k][:live] + (a[i - 1, :live] != b[j - 1, :live])
            if k < 2 * reach:
                best = np.minimum(best, one[k + 1][:live] + np.int8(1))
            if k:
                best = np.minimum(best, row[k - 1] + np.int8(1))
            if i > 1 and j > 1:
                swap = (a[i - 1, :live] == b[j - 2, :live]) & (a[i - 2, :live] == b[j - 1, :live])
                best = np.where(swap, np.minimum(best, two[k][:live] + np.int8(1)), best)
            row.append(np.minimum(best, np.int8(SLIPS)))
        done = np.arange(int(np.searchsorted(-n, -i, side="left")), live)
        result[done] = np.stack(row)[(m - n)[done] + reach, done]
        two, one = one, row
    out[rows] = result
    return out


class Words:
    """Words with what pair_features asks of each, in arrays. What is longer than WIDTH is compared one by one."""

    WIDTH = 64

    def __init__(self, words: list[str]):
        self.words, self.shapes = words, [shape(w) for w in words]
        self.grams = np.array([len(grams(w)) for w in words])
        self.sides = [self._codes(words), self._codes(self.shapes)]
        self.odd = np.array([float(any(not c.isalpha() for c in w)) for w in words])
        self.ends = np.array([[ord(w[0]), ord(w[-1])] for w in words])

    def _codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.zeros((len(words), self.WIDTH), np.int32)
        for k, w in enumerate(words):
            codes[k, : len(w)] = [ord(c) for c in w[: self.WIDTH]]
        return codes, np.array([len(w) for w in words])

    def slips(self, side: int, at: np.ndarray, other: Words, there: np.ndarray) -> np.ndarray:
        (a, n), (b, m) = self.sides[side], other.sides[side]
        n, m = n[at], m[there]
        out, fits = np.full(len(at), SLIPS, np.int8), (n <= self.WIDTH) & (m <= self.WIDTH)
        out[fits] = slips_many(a[at[fits]], n[fits], b[there[fits]], m[fits])
        x, y = (self.words, other.words) if side == 0 else (self.shapes, other.shapes)
        for k in np.flatnonzero(~fits):
            out[k] = min(SLIPS, slips(x[at[k]], y[there[k]], SLIPS - 1))
        return out


def pairs_features(left: Words, at: np.ndarray, right: Words, there: np.ndarray, common: np.ndarray, log_known: np.ndarray) -> np.ndarray:
    """pair_features of many pairs of unlike shapes that share `common` grams, a feature a row."""
    first, last = (left.ends[at] == right.ends[there]).T
    n, m = left.sides[0][1][at], right.sides[0][1][there]
    jaccard = common / (left.grams[at] + right.grams[there] - common)
    return np.stack([np.zeros(len(at)), left.slips(0, at, right, there), left.slips(1, at, right, there), jaccard, m, left.odd[at], first, last, log_known[there], n - m])


def outranked(alike: DataFrame, known: DataFrame, ranker) -> DataFrame:
    """(word): those of (word, p) beside which a word of another shape, of all known ones that share a gram, ranks above p."""
    sizes = [max(1, -(-x.count() // n)) for x, n in ((alike, LEFT), (known, RIGHT))]
    own = [F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in zip(("word", "right"), sizes)]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in sizes]
    cells = min(sizes[0] * sizes[1], 4096)
    left = alike.select(own[0].alias("i"), every[1].alias("j"), "word", "p").repartition(cells, "i", "j")
    right = known.select(every[0].alias("i"), own[1].alias("j"), "right", "texts").repartition(cells, "i", "j")

    def judge(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(others):
            return pd.DataFrame({"word": []}, dtype=object)
        a, b, p = Words(some["word"].tolist()), Words(others["right"].tolist()), some["p"].to_numpy()
        lists, log_known = gram_lists(b.words), np.log1p(others["texts"].to_numpy())
        shapes: dict[str, list[int]] = {}
        for k, x in enumerate(b.shapes):
            shapes.setdefault(x, []).append(k)
        found, ready, size = set(), [], 0
        for k, word in enumerate(a.words):
            n = shared_grams(word, lists, len(b.words))
            n[shapes.get(a.shapes[k], [])] = 0
            there = np.flatnonzero(n)
            ready.append((np.full(len(there), k), there, n[there]))
            size += len(there)
            if size >= PAIRS or k + 1 == len(a.words):
                at, there, common = (np.concatenate(x) for x in zip(*ready))
                above = ranker.value.above(pairs_features(a, at, b, there, common, log_known), p[at], {0: 0.0})
                found.update(at[above].tolist())
                ready, size = [], 0
        return pd.DataFrame({"word": [a.words[k] for k in sorted(found)]}, dtype=object)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(judge, "word string").distinct()


def find_corrections(counts: DataFrame) -> DataFrame:
    """(word, right): the replacement of each word of scanned texts that is a misread form of a known one."""
    spark = counts.sparkSession
    # known: in clean texts; without any clean text, what scanned texts have far more often than its rivals
    clean = bool(counts.filter("clean > 0").limit(1).count())
    usable = (F.length("word") > 1) & F.col("word").rlike(r"^[\p{L}]+$")
    known = counts.filter(usable & ((F.col("clean") > 0) if clean else (F.col("scanned") > 4)))
    read = counts.filter((F.length("word") > 1) & (F.col("scanned") + F.col("cut") > 0) & ~F.col("word").contains("-"))

    @F.pandas_udf("string")
    def shaped(words: pd.Series) -> pd.Series:
        return words.map(shape)

    known = cut(known.select("word", (F.col("clean") + F.col("scanned")).alias("texts"), shaped("word").alias("shape")))
    read = read.select("word", (F.col("scanned") + F.col("cut") + F.col("clean") * CLEAN_WEIGHT).alias("seen"), shaped("word").alias("shape"))
    # a word can only be put right, be it in clean texts (some of which are short scans and quotes) or in none, by a far
    # commoner one of its shape; rarer ones don't take its place, whatever their rank
    rivals = known.groupBy("shape").agg(F.max("texts").alias("most"))
    unknown = read.join(rivals, "shape").filter(F.col("most") >= 2 * F.col("seen"))
    right = known.withColumnRenamed("word", "right")
    pairs = unknown.join(right, "shape").filter((F.col("word") != F.col("right")) & (F.col("texts") >= 2 * F.col("seen"))).select("word", "right", "texts")
    sample = known.orderBy(F.xxhash64("word"), "word").limit(TRAIN_ROWS).collect()
    ranker = spark.sparkContext.broadcast(fit_ranker([(r.word, r.texts) for r in sample]))

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array([pair_features(w, r, t) for w, r, t in zip(frame["word"], frame["right"], frame["texts"])]).reshape(-1, 10)
            yield frame.assign(p=ranker.value.predict(x) if len(x) else [])

    ranked = pairs.mapInPandas(rank, "word string, right string, texts long, p double").filter("p > 0.5")
    alike = cut(ranked.groupBy("word").agg(F.max(F.struct("p", "texts", "right")).alias("b")).select("word", "b.right", "b.p"))
    chosen = cut(alike.join(outranked(alike, right, ranker), "word", "left_anti").select("word", "right"))
    return followed(chosen)


def followed(chosen: DataFrame) -> DataFrame:
    """(word, right): what is right for one word may be a misread form itself, so each is followed to its end. A right word is
    in more texts than the one it replaces, so there are no rings; every round doubles the steps."""
    while True:
        further = chosen.select(F.col("word").alias("right"), F.col("right").alias("further"))
        moved = cut(chosen.join(further, "right", "left").select("word", F.coalesce("further", "right").alias("right"), F.col("further").isNotNull().alias("moved")))
        chosen = moved.select("word", "right")
        if not moved.filter("moved").limit(1).count():
            return chosen


def _split_rows(x: DataFrame) -> DataFrame:
    """Features of lines that end in a hyphen, in columns."""
    log = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    return x.select("id", "line", "next_line", "whole", "kind", F.array(log("n_whole"), log("n_pair"), log("n_left"), log("n_right"), F.col("fixed").isNotNull().cast("double"), F.col("kind").cast("double"), F.length("left").cast("double"), F.length("right").cast("double"), F.col("low").cast("double")).alias("x"), "fixed", "left")


def scan_defects(sources: DataFrame) -> DataFrame:
    """(id, line_no, defect, word, right, at) of texts read from scanned pages, lines counted from 1.

    defect is 'furniture' (running headers and footers and page numbers, damaged or not; such a line has no other), and
    'split_word' (word: the word as one) or 'misread' (word and right: what stands there and what it should be; right is
    null for stray marks). Texts that aren't laid out in lines of a page (tables, chats, code, texts with one line a
    paragraph) have no rows, nor have null and empty texts. Several deliveries of an id count as one.
    """
    spark = sources.sparkSession
    texts = _texts(sources)
    surveyed = cut(survey(texts))
    counts = cut(word_counts(surveyed))
    corrections = cut(find_corrections(counts))
    # a bounded sample of labelled lines for the furniture classifier, by a hash of the features
    labelled = surveyed.filter("label >= 0").select("x", "label")
    sample = [r for k in (0, 1) for r in labelled.filter(F.col("label") == k).orderBy(F.xxhash64("x")).limit(TRAIN_ROWS // 2).collect()]
    furniture = None
    if len({r.label for r in sample}) == 2:
        furniture = Bagged.fit(np.array([r.x for r in sample]), np.array([r.label for r in sample], dtype=float))
    shared = spark.sparkContext.broadcast(furniture)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "line", "what", "word", "next_line", "whole", "pair", "left", "right", "kind", "low"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = []
            for i, title, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                page = read_page(text, title)
                if not page.scanned:
                    continue
                score = shared.value.predict(page.features) if shared.value else np.array(page.labels, dtype=float)
                skip = {n for n, p, label in zip(page.candidates, score, page.labels) if p > 0.5}
                rows.extend((i, n, "furniture", *[None] * 8) for n in sorted(skip))
                ends = split_ends(page, skip)
                for n, m, a, b, kind, low in ends:
                    rows.append((i, n, "end", None, m, *joined(a, b), kind, int(low)))
                drop_last, drop_first = {e[0] for e in ends}, {e[1] for e in ends}
                for n, line in enumerate(page.lines):
                    if n in skip or not line.strip():
                        continue
                    tokens = line.split()
                    if any(t in STRAYS for t in tokens) and not line.lstrip().startswith("|") and sum(t.isalpha() for t in tokens) >= 2:
                        rows.append((i, n, "stray", *[None] * 8))
                    tokens = tokens[1 if n in drop_first else 0 : -1 if n in drop_last else None]
                    rows.extend((i, n, "word", w, *[None] * 7) for w in dict.fromkeys(p.lower() for t in tokens for p in parts_of(t) if len(p) > 1))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    schema = "id string, line int, what string, word string, next_line int, whole string, pair string, left string, right string, kind int, low int"
    seen = cut(texts.mapInArrow(observe, schema))
    words = seen.filter("what = 'word'").select("id", "line", "word")
    misread = lookup_join(words, corrections, ["word"], spread=F.col("id")).select("id", "line", F.lit("misread").alias("defect"), "word", "right")
    marks = seen.filter("what in ('furniture', 'stray')").select("id", "line", F.when(F.col("what") == "stray", "misread").otherwise("furniture").alias("defect"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("right"))
    ends = cut(seen.filter("what = 'end'").select("id", "line", "next_line", "whole", "pair", "left", "right", "kind", "low").distinct())
    total = counts.select("word", (F.col("clean") + F.col("scanned")).alias("n"))
    for column in ("whole", "pair", "left", "right"):
        ends = lookup_join(ends, total.select(F.col("word").alias(column), F.col("n").alias(f"n_{column}")), [column], "left", spread=F.col("id"))
    ends = lookup_join(ends, corrections.select(F.col("word").alias("whole"), F.col("right").alias("fixed")), ["whole"], "left", spread=F.col("id"))
    rows = cut(_split_rows(ends))
    fit_on = rows.orderBy(F.xxhash64("id", "line"), "id", "line").limit(TRAIN_ROWS).select("x").collect()
    splitter = spark.sparkContext.broadcast(fit_splitter(np.array([r.x for r in fit_on]).reshape(-1, 9)))

    @F.pandas_udf("double")
    def is_split(x: pd.Series) -> pd.Series:
        return pd.Series(splitter.value(np.array(x.tolist()).reshape(-1, 9)))

    judged = rows.withColumn("p", is_split("x")).filter("p > 0.5")
    cuts = judged.select("id", "line", F.lit("split_word").alias("defect"), F.col("whole").alias("word"), F.lit(None).cast("string").alias("right"))

    @F.pandas_udf("boolean")
    def spoilt_left(whole: pd.Series, fixed: pd.Series, left: pd.Series) -> pd.Series:
        return pd.Series([w[: len(part)] != f[: len(part)] for w, f, part in zip(whole, fixed, left)])

    broken = judged.filter("fixed is not null").withColumn("at_left", spoilt_left("whole", "fixed", "left"))
    broken = broken.select("id", F.when(F.col("at_left") | (F.col("next_line") < 0), F.col("line")).otherwise(F.col("next_line")).alias("line"), F.lit("misread").alias("defect"), F.col("whole").alias("word"), F.col("fixed").alias("right"))
    found = misread.union(marks).union(cuts).union(broken)
    return found.select("id", (F.col("line") + 1).alias("line_no"), "defect", "word", "right").distinct()


def split_by_rule(x: np.ndarray) -> np.ndarray:
    """For texts too few to learn from: known as one, or a printed hyphen sign, or an unknown rest and no compound."""
    return ((x[:, 0] > x[:, 1]) | (x[:, 4] > 0) | (x[:, 5] >= 2) | (x[:, 3] == 0) & (x[:, 1] == 0)).astype(float)


def fit_splitter(x: np.ndarray):
    """A classifier of line ends from counts of the word as one, as a compound and of its parts.

    Weak labels: known as one and not as a compound, or the other way round. It is also shown rows whose words count as
    unknown, so it learns to judge by the parts and the kind of hyphen.
    """
    one, pair = (x[:, 0] > 0) | (x[:, 4] > 0), x[:, 1] > 0
    sure = one != pair
    if not len(x) or len(set(one[sure])) < 2:
        return split_by_rule
    known, y = x[sure], one[sure].astype(float)
    blind = known.copy()
    blind[:, [0, 1, 4]] = 0
    forest = Bagged.fit(np.concatenate([known, known, blind]), np.concatenate([y, y, y]), count=15, depth=6)
    return forest.predict


def repair_texts(sources: DataFrame, defects: DataFrame) -> DataFrame:
    """(id, text): the texts that have defects, as continuous paragraphs without furniture, with their words put right.

    Defects of a text are brought together by its id (they are fewer than its words). A paragraph ends at an empty line
    that isn't part of a page break, and before an indented line.
    """
    by_id = defects.groupBy("id").agg(F.collect_list(F.struct("line_no", "defect", "word", "right")).alias("found"))
    whole = _texts(sources).dropDuplicates(["id"]).join(by_id, "id").select("id", "text", "found")

    def mend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "text": [mended(t, [(f["line_no"], f["defect"], f["word"], f["right"]) for f in found]) for t, found in zip(frame["text"], frame["found"])]})

    return whole.mapInPandas(mend, "id string, text string")


def mended(text: str, found: list[tuple[int, str, str | None, str | None]]) -> str:
    lines = [line.rstrip("\r \t") for line in text.split("\n")]
    skip = {n - 1 for n, d, _, _ in found if d == "furniture"}
    cuts = {n - 1 for n, d, _, _ in found if d == "split_word"}
    words: dict[int, dict[str, str]] = {}
    for n, d, w, r in found:
        if d == "misread" and w and r:
            words.setdefault(n - 1, {})[w] = r
    out, current, open_cut, fixes = [], "", False, {}
    for i, line in enumerate(lines):
        if i in skip:
            continue
        if not line.strip():
            around = any(j in skip for j in range(max(0, i - 2), min(len(lines), i + 3)))
            if current and not open_cut and not (around and not ENDED.search(current)):
                out.append(put_right(current, fixes))
                current, fixes = "", {}
            continue
        if current and line[:2] == "  " and not open_cut:
            out.append(put_right(current, fixes))
            current, fixes = "", {}
        fixes |= words.get(i, {})
        stripped = line.strip()
        current += stripped if not current or open_cut or current[-1] in HYPHENS else " " + stripped
        open_cut = i in cuts
        if open_cut:
            current = current.rstrip(HYPHENS)
    if current:
        out.append(put_right(current, fixes))
    return "\n\n".join(out)


def put_right(paragraph: str, fixes: dict[str, str]) -> str:
    def fix(m: re.Match) -> str:
        word = m.group()
        right = fixes.get(word.lower())
        if right is None:
            return word
        return right.upper() if word.isupper() and len(word) > 2 else right[:1].upper() + right[1:] if word[:1].isupper() or word[:1] == "7" else right

    return " ".join(re.sub(r"[A-Za-zÀ-ÿ0-9@!$|]+", fix, t) for t in paragraph.split() if t not in STRAYS)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_defects(table(spark, folder, "source_item"))
    return found.select(F.col("id").alias("source_id"), "line_no", "defect").distinct()


def p5_texts(spark: SparkSession, folder: str) -> DataFrame:
    sources = table(spark, folder, "source_item")
    return repair_texts(sources, cut(scan_defects(sources))).select(F.col("id").alias("source_id"), "text")


QUERIES = {"p5_found": p5_found, "p5_texts": p5_texts}
SQL: dict[str, str] = {}
