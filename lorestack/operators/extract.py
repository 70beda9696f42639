"""Statements, figures, contradictions, summaries and answers taken from text by rule.

What belongs to one document is found in one Arrow pass over it: nothing is shuffled to number or weigh its sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.operators.capture import count
from lorestack.session import cut, spread_small

_FLAGS = re.I | re.A
# Cues of kinds of statements, first match wins: (kind, epistemic, confidence, cue).
CUES = (
    ("decision", "conclusion", 0.7, r"\b(we|i|they)\s+(decided|agreed|chose|will use|are going to use|settled on)\b"),
    ("decision", "conclusion", 0.55, r"\b(decision|decided|resolution)\b"),
    ("lesson", "conclusion", 0.6, r"\b(learned|lesson|takeaway|in hindsight|next time)\b"),
    ("hypothesis", "hypothesis", 0.6, r"\b(might|may|could|possibly|perhaps|suspect|hypothes|unclear whether)\b"),
    ("note", "inference", 0.5, r"\b(because|therefore|so that|which means|as a result)\b"),
    ("observation", "observation", 0.6, r"\b(measured|observed|recorded|saw|showed|reported|result was)\b"),
    ("task", "belief", 0.55, r"\b(must|should|need to|todo|action item|follow up)\b"),
    ("fact", "fact", 0.5, r"\b(is|are|was|were|has|have)\b.*\b\d"),
)
QUESTION, DEFAULT = ("question", "belief", 0.75), ("note", "observation", 0.4)
_CUES = [(kind, epistemic, sure, re.compile(cue, _FLAGS)) for kind, epistemic, sure, cue in CUES]
_FIGURE, _PRONOUN = re.compile(r"\b\d", re.A), re.compile(r"(it|this|that|they|these|those|he|she|there)\b", _FLAGS)
_FIRST = re.compile(r"^\W*\S+", re.A)
_PROPER = re.compile(r"(?<![A-Za-z0-9_])[A-Z][a-zà-öø-ÿ]{2,}")
_LAYOUT = re.compile(r"\|\s*-{3,}|<!--|-->|^\s*(?://|--|#!)|={5,}|-{5,}|\b(?:require|function|const|local|import)\s*[({]", re.A)
_SETTING, _SIGNS, _LETTERS = re.compile(r"[\w\]\"']\s*=\s*[\[{\"'\w]", re.A), re.compile(r"[=<>{}\[\]|;:\\/\"'`_*#+]"), re.compile(r"[A-Za-z]")


def half_up(value: float, digits: int) -> float:
    return math.floor(value * 10**digits + 0.5) / 10**digits


def structured(line: str) -> bool:
    """looks_structured for one string."""
    if line.count("|") >= 3 or len(_SETTING.findall(line)) >= 2 or _LAYOUT.search(line):
        return True
    letters = len(_LETTERS.findall(line))
    return letters > 0 and len(_SIGNS.findall(line)) > letters * 0.35


def classify(sentence: str) -> tuple[str, str, float]:
    """(kind, epistemic, confidence) of a sentence: a question, else its first cue, with its usefulness weighed in."""
    kind, epistemic, sure = QUESTION if re.search(r"\?\s*$", sentence) else next((c[:3] for c in _CUES if c[3].search(sentence)), DEFAULT)
    return kind, epistemic, usefulness(sentence, sure)


def usefulness(sentence: str, sure: float) -> float:
    """The confidence, higher for figures and proper names, lower for leading pronouns and very short or long sentences."""
    n = len(sentence.split())
    change = (0.08 if _FIGURE.search(sentence) else 0.0) - (0.12 if _PRONOUN.match(sentence.strip()) else 0.0)
    change += (-0.08 if n < 8 else -0.06 if n > 40 else 0.0) + (0.05 if _PROPER.search(_FIRST.sub("", sentence)) else 0.0)
    return half_up(max(0.25, min(0.85, sure + change)), 2)


def per_row(docs: DataFrame, key: str, text: Column, rows: Callable[[str], Iterable[tuple]], schema: list[tuple[str, pa.DataType]]) -> DataFrame:
    """One pass over (key, text): rows(text) gives the tuples of each text, whose fields are `schema`."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", *[n for n, _ in schema]]
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.string(): "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    found = list(rows(t))
                    at.extend([i] * len(found))
                    out.extend(found)
            columns = list(zip(*out)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(list(c), t) for c, (_, t) in zip(columns, schema))], names)

    return spread_small(docs.select(F.col(key).alias("key"), text.alias("text"))).mapInArrow(run, ", ".join([f"key {kind}", *(f"{n} {kinds[t]}" for n, t in schema)]))


def claim_rows(text: str, limit: int = 12) -> list[tuple[int, str, str, str, float]]:
    out = []
    for pos, sentence in enumerate(T.py_sentences(text)):
        if count(sentence) <= 120 and len(T.py_content_terms(sentence)) >= 4 and not structured(sentence):
            out.append((pos, sentence, *classify(sentence)))
            if len(out) >= limit:
                break
    return out


def claims(docs: DataFrame, key: str, text: Column, limit: int = 12) -> DataFrame:
    """(key, pos, claim, kind, epistemic, confidence): the first `limit` sentences with at least four content terms, at most
    120 tokens and no layout, classified. Null and empty texts have none."""
    fields = [("pos", pa.int64()), ("claim", pa.string()), ("kind", pa.string()), ("epistemic", pa.string()), ("confidence", pa.float64())]
    return per_row(docs, key, text, lambda t: claim_rows(t, limit), fields)


def claim_budget(text: str) -> int:
    """Claims that a document may give: one for 120 words, 20 to 200."""
    return max(20, min(200, math.floor(len(text.split()) / 120 + 0.5)))


def normal_claim(text: str) -> str:
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def long_claims(docs: DataFrame, key: str, text: Column, piece_tokens: int = 400, whole: int = 6000) -> DataFrame:
    """(key, pos, claim, kind, epistemic, confidence) of texts of any length: those over `whole` characters are read in
    pieces of `piece_tokens`, each with its share of the document's budget; equal statements count once."""
    from lorestack.operators.capture import chunk

    def rows(t: str) -> Iterator[tuple]:
        budget = claim_budget(t)
        pieces = [t] if len(t) <= whole else [c for c, _, _ in chunk(t, piece_tokens, 0)]
        seen: set[str] = set()
        pos = 0
        share = max(2, math.ceil(budget / len(pieces))) if len(pieces) > 1 else budget
        for piece in pieces:
            fresh = 0
            for _, claim, *rest in claim_rows(piece, len(piece)):
                if pos < budget and fresh < share and (normal := normal_claim(claim)) not in seen:
                    seen.add(normal)
                    yield (pos, claim, *rest)
                    pos, fresh = pos + 1, fresh + 1

    fields = [("pos", pa.int64()), ("claim", pa.string()), ("kind", pa.string()), ("epistemic", pa.string()), ("confidence", pa.float64())]
    return per_row(docs, key, text, rows, fields)


def sentence_kinds(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, kind, epistemic, confidence) of every sentence."""
    fields = [("pos", pa.int64()), ("kind", pa.string()), ("epistemic", pa.string()), ("confidence", pa.float64())]
    return per_row(docs, key, text, lambda t: ((i, *classify(s)) for i, s in enumerate(T.py_sentences(t))), fields)


# Units of figures (longer ones first), what scales a number, and spellings of one unit.
UNITS = (
    "%|percent|thousand|million|billion|minutes?|mins?|seconds?|secs?|hours?|hrs?|days?|weeks?|months?|years?|people|usd|eur|gbp|inr|"
    "kib|mib|gib|tib|khz|mhz|ghz|kb|mb|gb|tb|fps|rpm|px|hz|ms|µs|us|ns|bn|k|m"
)
SCALE = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9}
EXACT = {"ms", "µs", "us", "ns", "kb", "mb", "gb", "tb", "kib", "mib", "gib", "tib", "hz", "khz", "mhz", "ghz", "px", "fps", "rpm"}
SHORT_UNITS = {"min": "minute", "sec": "second", "hr": "hour", "percent": "%"}
_NUMBER = re.compile(rf"([$£€₹]?)\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?({UNITS})?(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))", re.I)


def numbers(text: str) -> list[tuple[str, float]]:
    """Distinct (unit, value) of the figures of a text: separators of thousands dropped, magnitudes multiplied out."""
    found: dict[tuple[str, float], None] = {}
    for m in _NUMBER.finditer(text):
        suffix = (m[3] or "").lower()
        value = float(m[2].replace(",", "")) * SCALE.get(suffix, 1)
        unit = "currency" if m[1] else "count" if suffix in SCALE or not suffix else suffix if suffix in EXACT else SHORT_UNITS.get(re.sub("s$", "", suffix), re.sub("s$", "", suffix))
        found.setdefault((unit, value))
    return list(found)


def figures(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, unit, value): distinct figures of each text."""
    return per_row(docs, key, text, numbers, [("unit", pa.string()), ("value", pa.float64())])


# Words that deny.
_NEGATION = re.compile(r"\b(not|no|never|cannot|can't|won't|doesn't|didn't|isn't|aren't|wasn't|weren't|without|failed to|rejected|dropped|abandoned)\b", _FLAGS)


def contradiction(a: str, b: str) -> tuple[str | None, float, float]:
    """(reason, confidence, overlap) of two statements; reason 'figures', 'negation' or None.

    Statements that share under 0.3 of their terms are about different things. With a unit in common, a figure that the
    other one doesn't have contradicts; else one negated and one not, if they share 0.45."""
    x, y = set(T.py_content_terms(a)), set(T.py_content_terms(b))
    overlap = len(x & y) / len(x | y) if x and y else 0.0
    if overlap < 0.3:
        return None, 0.0, overlap
    m, n = numbers(a), numbers(b)
    if {u for u, _ in m} & {u for u, _ in n} and any(not any(u == w and abs(v - z) < 1e-9 for w, z in n) for u, v in m):
        return "figures", half_up(min(0.7, 0.35 + overlap * 0.5), 4), overlap
    if bool(_NEGATION.search(a)) != bool(_NEGATION.search(b)) and overlap >= 0.45:
        return "negation", half_up(min(0.6, 0.3 + overlap * 0.4), 4), overlap
    return None, 0.0, overlap


def _text(row: str) -> Column:
    return F.trim(F.concat(F.coalesce(F.col(f"{row}.title"), F.lit("")), F.lit(" "), F.coalesce(F.col(f"{row}.body"), F.lit(""))))


def judge_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, text_a, text_b) with reason, confidence and overlap added and the texts dropped, in one pass."""
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("a", "b")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [contradiction(x or "", y or "") for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(columns[0]), pa.string()), *(pa.array(list(c), pa.float64()) for c in columns[1:])], ["a", "b", "reason", "confidence", "overlap"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, reason string, confidence double, overlap double")


def propose_relations(pairs: DataFrame) -> DataFrame:
    """(a, b, type, confidence) of pairs (a, b, text_a, text_b, when_a, when_b): similar_to from an overlap of 0.55, else
    related_to from 0.25; contradicts; precedes or follows by recorded time where they are related."""
    judged = judge_pairs(pairs).join(pairs.select("a", "b", "when_a", "when_b"), ["a", "b"])
    o = F.col("overlap")
    alike = F.when(o >= 0.55, F.struct(F.lit("similar_to").alias("type"), T.round_half(F.least(F.lit(0.8), o), 4).alias("confidence"))).when(o >= 0.25, F.struct(F.lit("related_to").alias("type"), T.round_half(o, 4).alias("confidence")))
    against = F.when(F.col("reason").isNotNull(), F.struct(F.lit("contradicts").alias("type"), F.col("confidence")))
    order = F.when(F.col("when_a") < F.col("when_b"), "precedes").when(F.col("when_a") > F.col("when_b"), "follows")
    timed = F.when((o >= 0.25) & order.isNotNull(), F.struct(order.alias("type"), F.lit(0.5).alias("confidence")))
    return judged.select("a", "b", F.explode(F.array_compact(F.array(alike, against, timed))).alias("r")).select("a", "b", "r.type", "r.confidence")


def summary_rows(text: str, n: int) -> list[tuple[int, str, float]]:
    parts = T.py_sentences(text)
    terms = [T.py_content_terms(s) for s in parts]
    freq = Counter(t for x in terms for t in x)
    most = max(freq.values(), default=0)
    scored = []
    for i, x in enumerate(terms):
        if x:
            place = 1.35 if i == 0 else 1.15 if i == 1 else 1.05 if i == len(parts) - 1 else 1.0
            fit = 0.6 if len(x) < 5 else 0.75 if len(x) > 45 else 1.0
            scored.append((half_up(sum(freq[t] / most for t in x) / len(x) * place * fit, 6), i))
    best = sorted(scored, key=lambda r: (-r[0], r[1]))[:n]
    return [(i, parts[i], s) for s, i in sorted(best, key=lambda r: r[1])]


def summary(docs: DataFrame, key: str, text: Column, n: int = 3) -> DataFrame:
    """(key, pos, sentence, score): the n sentences whose terms are most frequent in the document, first ones favoured, in order."""
    return per_row(docs, key, text, lambda t: summary_rows(t, n), [("pos", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())])


def answers(docs: DataFrame, key: str, title: Column, text: Column, state: Column, question: str, retrospective: bool = False, n: int = 4, aside: int = 2, least: float = 0.15) -> DataFrame:
    """(key, pos, sentence, score, matched, part) for a question: the passages that quote an answer.

    A passage is a sentence of at least three terms; its score is the share of the question's stemmed terms that it or
    the title has. part is 'answer' (the n best of current records, or of replaced ones for a question about the past, or
    where there is nothing else) or 'aside' (the `aside` best of the others). Nothing if the best is under `least`.

    Texts without a word that begins like a term of the question aren't split; each task keeps its best n + aside of
    either kind, so next to nothing is shuffled."""
    wanted = {T.py_stem(t) for t in T.py_content_terms(question)}
    if not wanted:
        wanted = {"\x00"}
    kind = docs.schema[key].dataType.simpleString()
    keep = n + aside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        starts = tuple(w[:-1] if w.endswith("y") else w for w in wanted)
        for batch in batches:
            for k, head, body, gone in zip(*(c.to_pylist() for c in batch.columns)):
                low = T.py_fold(f"{head or ''}\n{body or ''}")
                if not any(s in low for s in starts):
                    continue
                titled = {T.py_stem(t) for t in T.py_content_terms(head)} & wanted
                for pos, sentence in enumerate(T.py_sentences(body)):
                    terms = [T.py_stem(t) for t in T.py_content_terms(sentence)]
                    if len(terms) >= 3 and (hit := titled | (set(terms) & wanted)):
                        best.append((k, pos, sentence, half_up(len(hit) / len(wanted), 4), sorted(hit), gone))
            for flag in (False, True):  # the best of either kind so far
                own = sorted((b for b in best if b[5] == flag), key=lambda b: (-b[3], b[0], b[1]))[:keep]
                best = [b for b in best if b[5] != flag] + own
        columns = list(zip(*best)) if best else [[]] * 6
        types = [None, pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) if t else pa.array(list(c)) for c, t in zip(columns, types)], ["key", "pos", "sentence", "score", "matched", "gone"])

    gone = F.coalesce(state.isin("superseded", "archived"), F.lit(False))
    found = docs.select(F.col(key).alias("key"), title.alias("t"), text.alias("b"), gone.alias("g")).mapInArrow(run, f"key {kind}, pos long, sentence string, score double, matched array<string>, gone boolean")
    found = cut(found)
    best_of = lambda flag, most: found.filter(F.col("gone") == flag).orderBy(F.desc("score"), "key", "pos").limit(most).collect()
    old, new = best_of(True, keep), best_of(False, keep)
    lead, rest = (old, new) if (retrospective and old) or not new else (new, old)
    lead, rest = lead[:n], rest[:aside] if lead is not rest else []
    if not lead or lead[0].score < least:
        lead = rest = []
    schema = f"key {kind}, pos long, sentence string, score double, matched array<string>, part string"
    out = [(r.key, r.pos, r.sentence, r.score, r.matched, part) for part, x in (("answer", lead), ("aside", rest)) for r in x]
    return docs.sparkSession.createDataFrame(out, schema)


def answer_confidence(scores: list[float], matched: list[Iterable[str]], terms: int) -> float:
    """How far an answer of quoted passages is to be trusted: terms covered, the best passage, and how many there are."""
    if not scores or not terms:
        return 0.0
    covered = len(set().union(*map(set, matched))) / terms
    return half_up(min(1.0, (0.6 * covered + 0.4 * min(1.0, scores[0])) * (1 if len(scores) <= 2 else 0.85)), 4)


def keywords(docs: DataFrame, key: str, text: Column, units: DataFrame, n_units: int, n: int = 10) -> DataFrame:
    """(key, term, score, rank): the n keywords of each text: frequency, rarity over units, length and first position.

    `units` is (term, df) over whatever is counted (documents, chunks), n_units their number. It is broadcast only below a
    checked size; beyond, the terms meet it by salted keys."""
    from pyspark.sql import Window

    from lorestack.session import lookup_join

    def rows(t: str) -> Iterator[tuple]:
        terms = T.py_content_terms(t)
        first: dict[str, int] = {}
        for i, x in enumerate(terms):
            first.setdefault(x, i)
        return ((x, c, len(terms), first[x]) for x, c in Counter(terms).items())

    tf = per_row(docs, key, text, rows, [("term", pa.string()), ("tf", pa.int64()), ("total", pa.int64()), ("first", pa.int64())])
    joined = lookup_join(tf, units, ["term"], "left", spread=F.col("key"))
    rarity = F.log((F.lit(n_units) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    place = 1.3 - 0.4 * F.least(F.col("first") / F.col("total") / 0.4, F.lit(1.0))
    score = F.col("tf") / F.col("total") * rarity * F.least(F.lit(1.15), 1 + (F.length("term") - 4) * F.lit(0.02)) * place
    own = Window.partitionBy("key").orderBy(F.desc("score"), "term")
    return joined.select("key", "term", T.round_half(score, 4).alias("score")).withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= n)


def unit_frequency(units: DataFrame, text: str) -> DataFrame:
    """(term, df): in how many rows of `units` a content term occurs; counted in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(t for x in batch.column(0).to_pylist() if x for t in set(T.py_content_terms(x)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    return spread_small(units.select(text)).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
