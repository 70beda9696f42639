"""The search language: text queries compile to intents, intents to predicates."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorestack.functions.text import STOPWORDS, content_terms
from lorestack.sources.tables import kind_key


@dataclass
class Intent:
    """What a query asks for."""

    kinds: list[str] = field(default_factory=list)
    origins: list[str] = field(default_factory=list)
    epistemics: list[str] = field(default_factory=list)
    states: list[str] = field(default_factory=list)
    reviews: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    near: str | None = None
    after: str | None = None
    before: str | None = None
    text: str = ""
    shape: str = "lookup"
    temporal: bool = False
    retrospective: bool = False


_FIELD = re.compile(r'(\w+):([^\s"]+|"[^"]*")')
_RANGE = re.compile(r"\b(today|yesterday|(?:this|last) (?:week|month|year)|\d+\s+(?:day|week|month|year)s?\s+ago)\b", re.I)
# Words that make a query a question, one about time, or one about what used to hold.
_QUESTION = re.compile(r"(what|who|when|where|why|how|which|did|do|does|is|are|was|were|should|can|could|would|will)\b", re.I)
_TIME = re.compile(r"\b(when|before|after|since|until|during|recently|lately|last (week|month|year|time)|this (week|month|year)|yesterday|today|ago|first|originally|used to|previously|history|timeline|changed)\b", re.I)
_PAST = re.compile(r"\b(used to|previously|originally|formerly|before|earlier|at the time|back then|old|former|what was|what were|did we use|have we changed|has .* changed|history of)\b", re.I)
_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
_STOP = frozenset(STOPWORDS)
_LAST = timedelta(days=1) - timedelta(milliseconds=1)


def resolve_range(phrase: str, now: str) -> tuple[str, str] | None:
    """[first, last] instant of a range in words, or of a year, month, day or instant; None if it isn't understood.

    Days end a millisecond before midnight. Weeks begin on Sunday; months have 30 and years 365 days when counted back."""
    at = datetime.fromisoformat(now)
    day = at.replace(hour=0, minute=0, second=0, microsecond=0)
    word = re.sub(r"^(this|last)-", r"\1 ", phrase.strip().lower())
    sunday = day - timedelta(days=(day.weekday() + 1) % 7)
    month, year = day.replace(day=1), day.replace(month=1, day=1)
    before = month - timedelta(days=1)
    known = {
        "today": (day, day + _LAST), "yesterday": (day - timedelta(days=1), day - timedelta(days=1) + _LAST),
        "week": (sunday, day + _LAST), "last week": (sunday - timedelta(days=7), sunday - timedelta(days=1) + _LAST),
        "month": (month, day + _LAST), "last month": (before.replace(day=1), before + _LAST),
        "year": (year, day + _LAST), "last year": (year.replace(year=year.year - 1), year - timedelta(days=1) + _LAST),
    }
    span = known.get(word.removeprefix("this "))
    if m := re.fullmatch(r"(\d+)\s*(day|week|month|year)s?\s*ago", word):
        span = day - timedelta(days=int(m[1]) * _DAYS[m[2]]), day + _LAST
    span = span or _span(word) or _span(phrase.strip())
    return None if span is None else (span[0].isoformat(sep=" "), span[1].isoformat(sep=" "))


def _span(text: str) -> tuple[datetime, datetime] | None:
    if m := re.fullmatch(r"(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", text):
        try:
            y, mo, d = int(m[1]), int(m[2] or 1), int(m[3] or 1)
            start = datetime(y, mo, d)
        except ValueError:
            return None
        end = start if m[3] else datetime(y, mo, calendar.monthrange(y, mo)[1]) if m[2] else datetime(y, 12, 31)
        return start, end + _LAST
    try:
        at = datetime.fromisoformat(text.replace("z", "+00:00").replace("Z", "+00:00")).replace(tzinfo=None)
    except ValueError:
        return None
    return at, at


def resolve_date(text: str, edge: str = "start", now: str = "1970-01-01") -> str | None:
    """The first or last instant of a year, month, day, range in words, or an instant; None if it isn't understood."""
    span = resolve_range(text, now)
    return None if span is None else span[0 if edge == "start" else 1]


def query_terms(text: str) -> list[str]:
    """Words of a query: without stopwords, unless it has nothing else."""
    raw = [t for t in re.findall(r"[^\W_](?:[^\W_]|[._-])*", text.lower()) if len(t) > 1]
    return [t for t in raw if t not in _STOP] or raw


def parse_query(text: str, now: str) -> Intent:
    """Reads, in this order, phrases in quotes, fields (kind:note after:2025-01), -exclusions, a range in words, and terms."""
    out = Intent(retrospective=bool(_PAST.search(text)))
    lists = {"kind": out.kinds, "type": out.kinds, "origin": out.origins, "from": out.origins, "epistemic": out.epistemics, "state": out.states, "tag": out.tags}

    def take(m: re.Match) -> str:
        name, value = m[1].lower(), m[2].strip('"')
        if name in lists:
            lists[name].append(value.lower())
        elif name == "is":
            if value in ("confirmed", "rejected", "unreviewed"):
                out.reviews[:] = [value]
            elif value in ("archived", "active", "superseded", "deleted"):
                out.states.append(value)
        elif name in ("after", "since"):
            out.after = resolve_date(value, "start", now)
        elif name in ("before", "until"):
            out.before = resolve_date(value, "end", now)
        elif name in ("during", "in"):
            if span := resolve_range(value, now):
                out.after, out.before = span
        elif name in ("related", "near"):
            out.near = value
        else:
            return m[0]
        return " "

    rest = re.sub(r'(\w+):("[^"]*")', take, text)
    rest = re.sub(r'"([^"]+)"', lambda m: out.phrases.append(m[1].strip()) or " ", rest)
    rest = _FIELD.sub(take, rest)
    rest = re.sub(r"(^|\s)-([\w-]{2,})", lambda m: out.exclude.append(m[2].lower()) or " ", rest)
    if m := _RANGE.search(rest):
        span = resolve_range(re.sub(r"\s+", " ", m[0]), now)
        out.after, out.before = out.after or span[0], out.before or span[1]
        rest = rest[: m.start()] + " " + rest[m.end() :]
    out.text = " ".join(rest.split())
    out.terms = list(dict.fromkeys([*query_terms(out.text), *(t for p in out.phrases for t in query_terms(p))]))
    out.temporal = bool(_TIME.search(text) or out.after or out.before)
    whole = text.strip()
    out.shape = "browse" if not whole else "question" if _QUESTION.match(whole) or whole.endswith("?") else "lookup" if out.terms or out.phrases else "browse"
    return out


def intent_filter(intent: Intent, text: Column | None = None, include_archived: bool = False) -> Column:
    """The predicate of an intent on object columns (kind, origin, epistemic, state, review, attrs, occurred_at, created_at).

    Deleted objects never pass, archived and superseded ones only when asked for by state or by the caller. Tags are
    compared without case. With `text`, objects with an excluded word among their content terms don't pass."""
    test = F.col("state") != "deleted"
    test = test & (F.col("state").isin(*intent.states) if intent.states else F.lit(True) if include_archived else ~F.col("state").isin("archived", "superseded"))
    for column, wanted in ((kind_key(), intent.kinds), (F.col("origin"), intent.origins), (F.col("epistemic"), intent.epistemics), (F.col("review"), intent.reviews)):
        if wanted:
            test = test & column.isin(*wanted)
    at = F.coalesce("occurred_at", "created_at")
    if intent.after:
        test = test & (at >= F.lit(intent.after).cast("timestamp_ntz"))
    if intent.before:
        test = test & (at <= F.lit(intent.before).cast("timestamp_ntz"))
    tags = F.transform(F.from_json(F.get_json_object("attrs", "$.tags"), "array<string>"), F.lower)
    for tag in intent.tags:
        test = test & F.coalesce(F.array_contains(tags, tag), F.lit(False))
    if intent.exclude and text is not None:
        test = test & ~F.arrays_overlap(content_terms(text), F.array(*map(F.lit, intent.exclude)))
    return test


def browse(objects: DataFrame, intent: Intent, limit: int = 100) -> DataFrame:
    """Objects that pass an intent's filters, newest first."""
    return objects.filter(intent_filter(intent)).orderBy(F.desc(F.coalesce("occurred_at", "created_at")), "id").limit(limit)
