"""Text kernels as Columns. They stay in the JVM; only nfkd() is a pandas UDF."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words without content, words that end like inflections.
STOPWORDS = (
    "a an the and or but if then else of in on at to for from by with without about as is are was were be been being do does did doing have has had having i me my we our you your he she it "
    "they them this that these those there here what which who whom when where why how not no nor so than too very can will just should now also into over under again further once "
    "because therefore however although while whereas since thus hence moreover furthermore their its his her us am would could might must shall may such more most many much some any all both each "
    "every other another same one two three first second next last new old own via per upon within"
).split()
WHOLE_WORDS = (
    "this has was does goes yes gas bus plus less press class cross series species news analysis basis status focus process access address thing string ring king during being spring".split()
)


def _bare(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not 0x300 <= ord(c) <= 0x36F)


def _folding() -> tuple[str, str, list[tuple[str, str]]]:
    """By rule, of all characters of the basic plane but the syllables of Korean: (characters, the first character of
    their decomposition, [(characters, what follows the first)]) where the rest is a mark of kana or Latin letters or dots."""
    chars, firsts, rests = [], [], {}
    for c in (chr(i) for i in range(0x80, 0x10000) if not 0xAC00 <= i <= 0xDFFF):
        bare = _bare(c)
        if bare == c or not bare or len(bare) > 1 and not (bare[1:] in ("\u3099", "\u309a") or re.fullmatch("[A-Za-z]{2,3}|[.]{2,3}", bare)):
            continue
        chars.append(c)
        firsts.append(bare[0])
        if len(bare) > 1:
            rests.setdefault(bare[1:], []).append(c)
    common = [(rest, "".join(x)) for rest, x in rests.items() if rest in ("\u3099", "\u309a", "i", "l", "f", "fi", "fl", ".", "..")]
    multiple = {c for x in rests.values() for c in x} - {c for _, x in common for c in x}
    kept = [(c, f) for c, f in zip(chars, firsts) if c not in multiple]
    return "".join(c for c, _ in kept), "".join(f for _, f in kept), common


_CHARS, _FIRSTS, _RESTS = _folding()


def fold(text: Column) -> Column:
    """Compatibility decomposition without accents, lower case.

    Equals nfkd() but for syllables of Korean and signs that stand for several letters other than f-ligatures and dots
    (units, fractions), which stay whole. Plain ASCII is only lowered."""
    out = text
    for rest, chars in _RESTS:
        out = F.regexp_replace(out, f"([{chars}])", f"$1{rest}")
    out = F.regexp_replace(F.translate(out, _CHARS, _FIRSTS), "[\u0300-\u036f]", "")
    return F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(text))


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining accents, lower case, for every script."""
    return text.map(lambda t: t if t is None else _bare(t).lower())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def tokenize(text: Column) -> Column:
    """Terms: runs of letters, digits and inner . _ - of 1 to 63 characters; none for null."""
    parts = F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}._-]+")
    trimmed = F.transform(parts, lambda t: F.regexp_replace(t, r"^[._-]+|[._-]+$", ""))
    return F.filter(trimmed, lambda t: (F.length(t) > 0) & (F.length(t) < 64))


def words(text: Column) -> Column:
    """Search terms: runs of letters and digits alone."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


def content_terms(text: Column) -> Column:
    """Terms that aren't single letters, stopwords or numbers of up to three digits."""
    return F.filter(tokenize(text), lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS) & ~t.rlike(r"^\d{1,3}$"))


def stem(term: Column) -> Column:
    """One inflectional ending less, then a silent e less; a key to match by, not a word."""
    undouble = lambda t: F.when(t.rlike(r"([bdfglmnprt])\1$"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    cut = lambda k: F.substring(term, F.lit(1), F.length(term) - k)
    n = F.length(term)
    stripped = (
        F.when(term.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(term.endswith("sses"), cut(2))
        .when(term.rlike("(ss|us|is)$"), term)
        .when((n > 4) & term.rlike("(ch|sh|x|z|s)es$"), cut(2))
        .when(term.endswith("s"), cut(1))
        .when(term.endswith("ing") & (n > 5), let(cut(3), undouble))
        .when(term.endswith("ed") & ~term.endswith("eed") & (n > 4), let(cut(2), undouble))
        .otherwise(term)
    )
    silent = lambda t: F.when((F.length(t) > 3) & t.endswith("e"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.when((n < 4) | term.isin(WHOLE_WORDS), term).otherwise(let(stripped, silent))


def match_terms(text: Column) -> Column:
    return F.transform(content_terms(text), stem)


def char_ngrams(term: Column, n: int = 3) -> Column:
    """Sliding n-grams of #term#."""
    padded = F.concat(F.lit("#"), term, F.lit("#"))
    return F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, n))).otherwise(F.array(padded))


def estimate_tokens(text: Column) -> Column:
    """max(characters / 4, words * 1.3), rounded up."""
    count = F.size(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0))
    return F.greatest(F.ceil(F.length(text) / 4), F.ceil(count * F.lit(1.3))).cast("long")


# Abbreviations that end no sentence, and all white space.
ABBREVIATION = r"(?i)(?<![A-Za-z0-9_])(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|approx|no|fig|vol|ch)\."
LETTERS = (r"(?i)(?<![A-Za-z0-9_])(e)\.(g\.)", r"(?i)(?<![A-Za-z0-9_])(i)\.(e\.)", r"(?<![A-Za-z0-9_])([A-Z])\.()")
SPACE = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? and a blank before a capital, digit, quote or bracket, and at empty lines; full stops of
    abbreviations (in any case) and of single capitals don't count."""
    guarded = F.regexp_replace(F.coalesce(text, F.lit("")), ABBREVIATION, "$1\u0001")
    for pattern in LETTERS:
        guarded = F.regexp_replace(guarded, pattern, "$1\u0001$2")
    parts = F.split(guarded, rf"(?<=[.!?]){SPACE}+(?=[A-Z0-9\"'\[(])|\n{{2,}}")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(F.translate(s, "\u0001", "."), rf"^{SPACE}+|{SPACE}+$", "")), lambda s: F.length(s) > 0)


def lexical_similarity(a: Column, b: Column) -> Column:
    """Shared content terms by all content terms; 0 if either has none."""
    x, y = F.array_distinct(content_terms(a)), F.array_distinct(content_terms(b))
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(shared / (F.size(x) + F.size(y) - shared))


def canonicalise(name: Column) -> Column:
    """Names as keys: folded, without a title, punctuation and double blanks."""
    bare = F.regexp_replace(fold(name), r"^\s*(mr|mrs|ms|dr|prof|sir)\.?\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[.,'\"()\[\]]", ""), r"\s+", " "))


def compare_names(a: Column, b: Column) -> Column:
    """Similarity of two canonical names: 1 equal, 0.8 prefix by words, 0.85 / 0.72 same last word and first initial,
    0.9 times the edit similarity where at most two edits and at least 0.85, else 0."""
    first = lambda x: F.element_at(F.split(x, " "), 1)
    last = lambda x: F.element_at(F.split(x, " "), -1)
    initial = (F.length(first(a)) == 1) | (F.length(first(b)) == 1)
    several = (F.size(F.split(a, " ")) > 1) & (F.size(F.split(b, " ")) > 1)
    edits = F.levenshtein(a, b)
    similarity = 1 - edits / F.greatest(F.length(a), F.length(b))
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(F.startswith(a, F.concat(b, F.lit(" "))) | F.startswith(b, F.concat(a, F.lit(" "))), F.lit(0.8))
        .when(several & (last(a) == last(b)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)), F.when(initial, F.lit(0.85)).otherwise(F.lit(0.72)))
        .when((edits <= 2) & (similarity >= 0.85), similarity * 0.9)
        .otherwise(F.lit(0.0))
    )


def excerpt(text: Column, terms: Sequence[str], size: int = 240) -> Column:
    """`size` characters that start a third of it before the first match of any term, with ellipses where text is left
    out; without a match, the beginning. Empty for null."""
    folded = fold(text)
    places = F.filter(F.array(*[F.locate(t, folded) for t in terms], F.lit(0)), lambda p: p > 0)
    at = F.when(F.size(places) > 0, F.array_min(places))
    start = F.greatest(F.lit(1), at - size // 3)
    head = F.when(start > 1, F.lit("…")).otherwise(F.lit(""))
    tail = lambda first: F.when(first + size - 1 < F.length(text), F.lit("…")).otherwise(F.lit(""))
    part = F.regexp_replace(F.substring(text, start, F.lit(size)), rf"^{SPACE}+|{SPACE}+$", "")
    window = F.when(at.isNull(), F.concat(F.substring(text, 1, size), tail(F.lit(1)))).otherwise(F.concat(head, part, tail(start)))
    return F.coalesce(window, F.lit(""))


def looks_structured(line: Column) -> Column:
    """Whether a line is a table row, settings, code, a comment, a ruler or mostly signs rather than prose."""
    letters, signs = F.length(F.regexp_replace(line, r"[^A-Za-z]", "")), F.length(F.regexp_replace(line, r"[^=<>{}\[\]|;:\\/\"'`_*#+]", ""))
    return (
        (F.regexp_count(line, F.lit(r"\|")) >= 3)
        | (F.regexp_count(line, F.lit(r"[\w\]\"']\s*=\s*[\[{\"'\w]")) >= 2)
        | line.rlike(r"\|\s*-{3,}|<!--|-->|^\s*(//|--|#!)|={5,}|-{5,}|\b(require|function|const|local|import)\s*[({]")
        | ((letters > 0) & (signs > letters * 0.35))
    )


def strip_addresses(text: Column) -> Column:
    """Text without code, links and file paths."""
    out = text
    for pattern in (r"(?s)```.*?```", r"`[^`]*`", r"(?i)\bhttps?://\S+", r"%\w+%[\\/][^\s\"']*", r"\b[A-Za-z]:\\[^\s\"']*", r"\.{0,2}[\\/][\w.-]+(?:[\\/][\w.-]+)+"):
        out = F.regexp_replace(out, pattern, " ")
    return out


def title_line(text: Column, limit: int = 120) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), r"\s+", " ")), 1, limit)


def duration_ms(text: Column) -> Column:
    """'45s', '10m', '2h' or minutes as milliseconds; null for anything else."""
    n = F.regexp_extract(text, r"^(\d+)([smh]?)$", 1)
    unit = F.regexp_extract(text, r"^(\d+)([smh]?)$", 2)
    factor = F.when(unit == "s", 1000).when(unit == "h", 3600000).otherwise(60000)
    return F.when(n != "", n.cast("long") * factor)


def round_half(value: Column, digits: int = 6) -> Column:
    """Rounds half up in double arithmetic, the same in every engine."""
    return F.floor(value * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))


# --- twins in Python, for questions on the driver and for passes over whole rows ------------------------------------------
_ABBREVIATION, _LETTERS = re.compile(ABBREVIATION), [re.compile(p) for p in LETTERS]
_JS_SPACE = "\\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_BREAK = re.compile(rf"(?<=[.!?])[{_JS_SPACE}]+(?=[A-Z0-9\"'\[(])|\n{{2,}}")
_STRIP = re.compile(rf"^[{_JS_SPACE}]+|[{_JS_SPACE}]+$")
_STOP, _WHOLE = frozenset(STOPWORDS), frozenset(WHOLE_WORDS)
_FOLD = str.maketrans(_CHARS, _FIRSTS)
_REST = {ord(c): _bare(c) for _, chars in _RESTS for c in chars}
_MARKS = re.compile("[\u0300-\u036f]")
_TERM = re.compile(r"(?:[^\W_]|[._-])+")
_SHORT_NUMBER = re.compile(r"[0-9]{1,3}")


def py_sentences(text: str | None) -> list[str]:
    guarded = _ABBREVIATION.sub("\\1\x01", text or "")
    for pattern in _LETTERS:
        guarded = pattern.sub("\\1\x01\\2", guarded)
    return [s for s in (_STRIP.sub("", p.replace("\x01", ".")) for p in _BREAK.split(guarded)) if s]


def py_fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", text.translate(_REST).translate(_FOLD)).lower()


def py_tokens(text: str | None) -> list[str]:
    return [t for t in (m.strip("._-") for m in _TERM.findall(py_fold(text or ""))) if 0 < len(t) < 64]


def py_content_terms(text: str | None) -> list[str]:
    return [t for t in py_tokens(text) if len(t) > 1 and t not in _STOP and not _SHORT_NUMBER.fullmatch(t)]


def py_stem(t: str) -> str:
    if len(t) < 4 or t in _WHOLE:
        return t
    undouble = lambda x: x[:-1] if len(x) > 1 and x[-1] == x[-2] and x[-1] in "bdfglmnprt" else x
    if t.endswith("ies") and len(t) > 4:
        s = t[:-3] + "y"
    elif t.endswith("sses"):
        s = t[:-2]
    elif t.endswith(("ss", "us", "is")):
        s = t
    elif len(t) > 4 and t.endswith(("ches", "shes", "xes", "zes", "ses")):
        s = t[:-2]
    elif t.endswith("s"):
        s = t[:-1]
    elif t.endswith("ing") and len(t) > 5:
        s = undouble(t[:-3])
    elif t.endswith("ed") and not t.endswith("eed") and len(t) > 4:
        s = undouble(t[:-2])
    else:
        s = t
    return s[:-1] if len(s) > 3 and s.endswith("e") else s
