"""Recurring phrases of a workspace."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.session import cut, lookup_join
from lorestack.sources.tables import kind_key

# Words that don't begin or end a concept, beside the stopwords.
NOISE = frozenset(T.STOPWORDS) | frozenset(
    "done get got make made use used using go going went really quite still only even never always often rather simply merely good bad big small cannot cant wont ought need needs want wants name names user users "
    "thing things way ways part case cases kind kinds type types item items goes run runs clone add adds set sets put puts take takes give gives keep keeps call calls see sees says say let lets true false null none".split()
)
_ADDRESS = [
    re.compile(p, f | re.A)
    for p, f in (
        (r"^\s*\|.*\|\s*$", re.M), (r"```.*?```", re.S), (r"`[^`]*`", 0), (r"\bhttps?://\S+", re.I), (r"\b[\w.-]+@[\w.-]+\.\w+", 0), (r"\b[\w.-]*/[\w./-]+", 0),
        (r"\b[\w-]+\.(?:js|ts|md|json|sh|py|c|h|html|yml|yaml|toml)\b", re.I),
    )
]
_ODD = re.compile(r"[-._/]|[0-9]")


def prose(text: str) -> str:
    """Text without table rows, code, links, addresses and paths."""
    for pattern in _ADDRESS:
        text = pattern.sub(" ", text)
    return text


def phrases(text: str, sizes: tuple[int, ...] = (2, 3)) -> Counter:
    """Runs of words that somebody might name: no short or odd words, none of NOISE at the ends."""
    words = T.py_tokens(prose(text))
    fine = [len(w) >= 3 and not _ODD.search(w) for w in words]
    out: Counter = Counter()
    for n in sizes:
        for i in range(len(words) - n + 1):
            if words[i] not in NOISE and words[i + n - 1] not in NOISE and all(fine[i : i + n]):
                out[" ".join(words[i : i + n])] += 1
    return out


def inside(phrase: str) -> list[str]:
    """All shorter phrases of two words and more that a phrase contains, as a string: words cut at the outer ends."""
    words = phrase.split(" ")
    out = set()
    for n in range(2, len(words) + 1):
        for i in range(len(words) - n + 1):
            first, middle, last = words[i], words[i + 1 : i + n - 1], words[i + n - 1]
            for a in range(len(first) - 2):
                for b in range(3, len(last) + 1):
                    out.add(" ".join([first[a:], *middle, last[:b]]))
    return sorted(out - {phrase})


def concepts(objects: DataFrame, least: int = 3) -> DataFrame:
    """(workspace_id, phrase, documents, occurrences, confidence) of the phrases that at least `least` active objects of a
    workspace share; objects has id, workspace_id, kind, title, body, state, review and attrs.

    Entities and rejected objects aren't read; a phrase that is the title or an alias of an entity is none, nor is one that
    a longer phrase of as many objects contains. Phrases are counted in each batch before they are shuffled."""
    usable = objects.filter((F.col("state") == "active") & (kind_key() != "entity") & ~F.coalesce(F.col("review") == "rejected", F.lit(False)))
    blank = F.lit("")
    rows = usable.select("workspace_id", F.concat(F.coalesce("title", blank), F.lit(". "), F.coalesce("body", blank)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs: Counter = Counter()
            times: Counter = Counter()
            for ws, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for phrase, n in phrases(text).items():
                    docs[ws, phrase] += 1
                    times[ws, phrase] += n
            keys = list(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([docs[k] for k in keys], pa.int64()), pa.array([times[k] for k in keys], pa.int64())],
                ["workspace_id", "phrase", "d", "t"],
            )

    found = rows.mapInArrow(count, "workspace_id string, phrase string, d long, t long").groupBy("workspace_id", "phrase").agg(F.sum("d").alias("documents"), F.sum("t").alias("occurrences")).filter(F.col("documents") >= least)
    entities = objects.filter(kind_key() == "entity").select("workspace_id", F.explode(F.array_union(F.array("title"), F.coalesce(F.from_json(F.get_json_object("attrs", "$.aliases"), "array<string>"), F.array().cast("array<string>")))).alias("n"))
    taken = entities.select("workspace_id", T.canonicalise(F.col("n")).alias("phrase")).distinct()
    found = cut(found.join(taken, ["workspace_id", "phrase"], "left_anti"))
    parts = F.pandas_udf(lambda s: s.map(inside), "array<string>")
    longer = found.select("workspace_id", F.col("documents").alias("_most"), F.explode(parts("phrase")).alias("phrase")).groupBy("workspace_id", "phrase").agg(F.max("_most").alias("_most"))
    # a plan takes `longer` for as small as `found`, of which it has dozens of rows for each; once broadcast, it stays so
    kept = found.join(longer.hint("merge"), ["workspace_id", "phrase"], "left").filter(F.col("_most").isNull() | (F.col("_most") < F.col("documents"))).drop("_most")
    totals = cut(usable.groupBy("workspace_id").agg(F.count("*").alias("total")))  # a row a workspace; uncut, it is taken for large and `kept` is broadcast
    n = F.col("documents")
    weight = 0.7 * F.least(F.lit(1.0), n / 8) + 0.3 * F.least(F.lit(1.0), n * 3 / F.col("total"))
    return lookup_join(kept, totals, ["workspace_id"], spread=F.col("phrase")).select("workspace_id", "phrase", "documents", "occurrences", T.round_half(0.45 + 0.25 * weight, 2).alias("confidence"))
