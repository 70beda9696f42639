"""Queries that take statements out of text, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.operators import capture as C
from lorestack.operators import extract as X
from lorestack.operators import graph as G
from lorestack.plans import duck
from lorestack.plans.base import Registry
from lorestack.plans.duck import EDGE, HEAD
from lorestack.session import cut
from lorestack.sources.tables import current_rows, table

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL

_S = f"s AS (SELECT doc_id, unnest({duck.sentences('text')}) AS claim, generate_subscripts({duck.sentences('text')}, 1) - 1 AS pos FROM documents)"
# Fixed values, written out apart from those of the engine.
_CUES = (
    ("decision", "conclusion", "0.7", r"\b(we|i|they)\s+(decided|agreed|chose|will use|are going to use|settled on)\b"), ("decision", "conclusion", "0.55", r"\b(decision|decided|resolution)\b"),
    ("lesson", "conclusion", "0.6", r"\b(learned|lesson|takeaway|in hindsight|next time)\b"), ("hypothesis", "hypothesis", "0.6", r"\b(might|may|could|possibly|perhaps|suspect|hypothes|unclear whether)\b"),
    ("note", "inference", "0.5", r"\b(because|therefore|so that|which means|as a result)\b"), ("observation", "observation", "0.6", r"\b(measured|observed|recorded|saw|showed|reported|result was)\b"),
    ("task", "belief", "0.55", r"\b(must|should|need to|todo|action item|follow up)\b"), ("fact", "fact", "0.5", r"\b(is|are|was|were|has|have)\b.*\b\d"),
)


def _cue(at: int, otherwise: str, question: str) -> str:
    return rf"CASE WHEN regexp_matches(claim, '\?\s*$') THEN {question} " + " ".join(f"WHEN regexp_matches(claim, '(?i){c[3]}') THEN {c[at] if at == 2 else repr(c[at])}" for c in _CUES) + f" ELSE {otherwise} END"


_KIND, _EPI, _SURE = _cue(0, "'note'", "'question'"), _cue(1, "'observation'", "'belief'"), _cue(2, "0.4", "0.75").replace("THEN 0", "THEN 0").replace(" END", " END")
_GAP = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]"
_N = rf"len([w for w in regexp_split_to_array(claim, '{_GAP}+') if length(w) > 0])"
_USE = rf"""floor(100 * greatest(0.25e0, least(0.85e0, CAST({_SURE} AS DOUBLE) + (CASE WHEN regexp_matches(claim, '\b\d') THEN 0.08e0 ELSE 0e0 END - CASE WHEN regexp_matches(claim, '(?i)^\s*(it|this|that|they|these|those|he|she|there)\b') THEN 0.12e0 ELSE 0e0 END
 + (CASE WHEN {_N} < 8 THEN -0.08e0 WHEN {_N} > 40 THEN -0.06e0 ELSE 0e0 END + CASE WHEN regexp_matches(regexp_replace(claim, '^\W*\S+', ''), '\b[A-Z][a-zà-öø-ÿ]{{2,}}') THEN 0.05e0 ELSE 0e0 END)))) + 0.5) / 100"""


@query(f"WITH {_S}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM s WHERE len({duck.content('claim')}) >= 4 AND {duck.estimate('claim')} <= 120 AND NOT {duck.structured('claim')}) SELECT doc_id, CAST(pos AS BIGINT) AS pos, claim, {_KIND} AS kind, {_EPI} AS epistemic, {_USE} AS confidence FROM f WHERE n <= 12")
def claim_candidates(spark, folder):
    return X.claims(table(spark, folder, "documents"), "doc_id", F.col("text")).withColumnRenamed("key", "doc_id")


@query()
def document_claims(spark, folder):
    """Statements of every document by its budget; long ones are read in pieces."""
    return X.long_claims(table(spark, folder, "documents"), "doc_id", F.col("text")).withColumnRenamed("key", "doc_id")


@query(f"WITH {_S}, f AS (SELECT {_KIND} AS kind, {_EPI} AS epistemic, {_USE} AS confidence FROM s) SELECT kind, epistemic, confidence, count(*) AS n FROM f GROUP BY 1, 2, 3")
def sentence_kinds(spark, folder):
    """Sentences by kind, epistemic and confidence."""
    s = X.sentence_kinds(table(spark, folder, "documents"), "doc_id", F.col("text"))
    return s.groupBy("kind", "epistemic", "confidence").agg(F.count("*").alias("n"))


_NUM = _GAP.join((r"([$£€₹]?)", r"?([0-9][0-9,]*(?:\.[0-9]+)?)", r"?(%|percent|thousand|million|billion|minutes?|mins?|seconds?|secs?|hours?|hrs?|days?|weeks?|months?|years?|people|usd|eur|gbp|inr|kib|mib|gib|tib|khz|mhz|ghz|kb|mb|gb|tb|fps|rpm|px|hz|ms|µs|us|ns|bn|k|m)?\b"))
_EACH = "unnest(" + f"list_zip(regexp_extract_all(t, '(?i){_NUM}', 1), regexp_extract_all(t, '(?i){_NUM}', 2), regexp_extract_all(t, '(?i){_NUM}', 3))" + ")"
_FIGS = f"""n AS (SELECT id, coalesce(x[1], '') AS sign, CAST(replace(x[2], ',', '') AS DOUBLE) AS v, lower(coalesce(x[3], '')) AS u FROM (SELECT id, {_EACH} AS x FROM o)),
fig AS (SELECT DISTINCT id, CASE WHEN sign <> '' THEN 'currency' WHEN u IN ('', 'k', 'thousand', 'm', 'million', 'bn', 'billion') THEN 'count' WHEN u IN ('ms', 'µs', 'us', 'ns', 'px', 'fps', 'rpm') OR u LIKE '%b' OR u LIKE '%hz' THEN u
 WHEN regexp_replace(u, 's$', '') = 'min' THEN 'minute' WHEN regexp_replace(u, 's$', '') = 'sec' THEN 'second' WHEN regexp_replace(u, 's$', '') = 'hr' THEN 'hour' WHEN u = 'percent' THEN '%' ELSE regexp_replace(u, 's$', '') END AS unit,
 v * (CASE WHEN u IN ('k', 'thousand') THEN 1e3 WHEN u IN ('m', 'million') THEN 1e6 WHEN u IN ('bn', 'billion') THEN 1e9 ELSE 1e0 END) AS value FROM n)"""


@query(f"WITH o AS (SELECT doc_id AS id, text AS t FROM documents), {_FIGS} SELECT id AS doc_id, unit, value FROM fig")
def figures(spark, folder):
    """Figures with units of each document."""
    return X.figures(table(spark, folder, "documents"), "doc_id", F.col("text")).withColumnRenamed("key", "doc_id")


def linked_pairs(spark, folder):
    """(a, b, text_a, text_b, when_a, when_b): objects that an active relation or a replacement ties, a < b."""
    rows = current_rows(table(spark, folder, "knowledge_object"), "title", "body", "state", "superseded_by", "occurred_at", "created_at").filter("state <> 'deleted'")
    rel = G.active(G.edges(table(spark, folder, "relation"))).filter("type <> 'mentions'").select("src_id", "dst_id")
    ends = rel.union(rows.filter("superseded_by is not null").select("id", "superseded_by")).toDF("x", "y").filter("x <> y")
    pairs = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    blank = F.lit("")
    texts = cut(rows.select("id", F.trim(F.concat(F.coalesce("title", blank), F.lit(" "), F.coalesce("body", blank))).alias("text"), F.coalesce("occurred_at", "created_at").alias("when")))
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}"), F.col("when").alias(f"when_{side}")), side)
    return pairs


_PAIRS = f"""{HEAD}, {EDGE}, alive AS (SELECT *, trim(coalesce(title, '') || ' ' || coalesce(body, '')) AS t FROM head WHERE state <> 'deleted'),
ends AS (SELECT src_id AS x, dst_id AS y FROM edge WHERE state = 'active' AND type <> 'mentions' AND src_id IS NOT NULL AND dst_id IS NOT NULL UNION ALL SELECT id, superseded_by FROM alive WHERE superseded_by IS NOT NULL),
pr AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM ends WHERE x <> y), used AS (SELECT DISTINCT id FROM (SELECT a AS id FROM pr UNION ALL SELECT b FROM pr)),
o AS (SELECT id, t, list_distinct({duck.content('t')}) AS terms, regexp_matches(t, '(?i)\b(not|no|never|cannot|can''t|won''t|doesn''t|didn''t|isn''t|aren''t|wasn''t|weren''t|without|failed to|rejected|dropped|abandoned)\b') AS neg, coalesce(occurred_at, created_at) AS at FROM alive WHERE id IN (FROM used)), {_FIGS},
ov AS (SELECT a, b, p.neg AS na, q.neg AS nb, p.at AS ta, q.at AS tb, CASE WHEN len(p.terms) = 0 OR len(q.terms) = 0 THEN 0e0 ELSE len(list_intersect(p.terms, q.terms)) / (len(p.terms) + len(q.terms) - len(list_intersect(p.terms, q.terms))) END AS overlap FROM pr JOIN o p ON p.id = a JOIN o q ON q.id = b),
same_unit AS (SELECT DISTINCT a, b FROM pr JOIN fig x ON x.id = a JOIN fig y ON y.id = b AND y.unit = x.unit),
other AS (SELECT DISTINCT a, b FROM pr JOIN fig x ON x.id = a WHERE NOT EXISTS (SELECT 1 FROM fig y WHERE y.id = b AND y.unit = x.unit AND abs(y.value - x.value) < 1e-9)),
j AS (SELECT ov.*, CASE WHEN overlap < 0.3 THEN NULL WHEN su.a IS NOT NULL AND ot.a IS NOT NULL THEN 'figures' WHEN na <> nb AND overlap >= 0.45 THEN 'negation' END AS reason FROM ov LEFT JOIN same_unit su ON su.a = ov.a AND su.b = ov.b LEFT JOIN other ot ON ot.a = ov.a AND ot.b = ov.b),
c AS (SELECT *, CASE reason WHEN 'figures' THEN floor(1e4 * least(0.7e0, 0.35e0 + overlap * 0.5e0) + 0.5) / 1e4 WHEN 'negation' THEN floor(1e4 * least(0.6e0, 0.3e0 + overlap * 0.4e0) + 0.5) / 1e4 END AS confidence FROM j)"""


@query(f"WITH {_PAIRS} SELECT a, b, reason, confidence FROM c WHERE reason IS NOT NULL")
def contradictions(spark, folder):
    """Linked objects that contradict each other: other figures for one unit, or one of them negated."""
    return X.judge_pairs(linked_pairs(spark, folder)).filter("reason is not null").select("a", "b", "reason", "confidence")


@query(
    f"""WITH {_PAIRS} SELECT a, b, CASE WHEN overlap >= 0.55 THEN 'similar_to' ELSE 'related_to' END AS type, floor(1e4 * CASE WHEN overlap >= 0.55 THEN least(0.8e0, overlap) ELSE overlap END + 0.5) / 1e4 AS confidence FROM c WHERE overlap >= 0.25
UNION ALL SELECT a, b, 'contradicts', confidence FROM c WHERE reason IS NOT NULL UNION ALL SELECT a, b, CASE WHEN ta < tb THEN 'precedes' ELSE 'follows' END, 0.5e0 FROM c WHERE overlap >= 0.25 AND ta <> tb"""
)
def relation_proposals(spark, folder):
    """What relations two linked objects should have, by what they share, contradict and when they were."""
    return X.propose_relations(cut(linked_pairs(spark, folder)))


@query(
    f"""WITH {_S}, w AS (SELECT doc_id, pos, unnest({duck.content('claim')}) AS t FROM s), f AS (SELECT doc_id, t, count(*) AS f FROM w GROUP BY 1, 2), m AS (SELECT doc_id, max(f) AS most FROM f GROUP BY 1),
p AS (SELECT w.doc_id, pos, avg(f / most) AS m, count(*) AS n FROM w JOIN f ON f.doc_id = w.doc_id AND f.t = w.t JOIN m ON m.doc_id = w.doc_id GROUP BY 1, 2), tot AS (SELECT doc_id, count(*) AS total FROM s GROUP BY 1),
x AS (SELECT s.doc_id, s.pos, claim, floor(1e6 * (m * (CASE WHEN s.pos = 0 THEN 1.35e0 WHEN s.pos = 1 THEN 1.15e0 WHEN s.pos = total - 1 THEN 1.05e0 ELSE 1e0 END) * (CASE WHEN n < 5 THEN 0.6e0 WHEN n > 45 THEN 0.75e0 ELSE 1e0 END)) + 0.5e0) / 1e6 AS score FROM s JOIN p ON p.doc_id = s.doc_id AND p.pos = s.pos JOIN tot ON tot.doc_id = s.doc_id)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, claim AS sentence, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM x) WHERE r <= 3"""
)
def extractive_summary(spark, folder):
    s = X.summary(table(spark, folder, "documents"), "doc_id", F.col("text"))
    return s.select(F.col("key").alias("doc_id"), "pos", "sentence", F.round("score", 4).alias("score"))


_ASK = "What happened to the harbour archive forecast and the turbine measurement?"


def _stems(x: str) -> str:
    return f"list_distinct([{duck.stem('m')} for m in {duck.content(x)}])"


@query(
    f"""WITH {HEAD}, alive AS (SELECT id, title, body, state IN ('superseded', 'archived') AS gone FROM head WHERE state <> 'deleted'), s AS (SELECT id, title, gone, unnest({duck.sentences('body')}) AS claim, generate_subscripts({duck.sentences('body')}, 1) - 1 AS pos FROM alive), q AS (SELECT {_stems(f"'{_ASK}'")} AS q),
h AS (SELECT id, pos, claim, gone, floor(1e4 * len(list_intersect(list_distinct(list_concat({_stems('claim')}, {_stems('title')})), q)) / len(q) + 0.5) / 1e4 AS score FROM s, q WHERE len({duck.content('claim')}) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY gone ORDER BY score DESC, id, pos) AS n FROM h WHERE score > 0)
SELECT id, CAST(pos AS BIGINT) AS pos, claim AS sentence, score, CASE WHEN gone THEN 'aside' ELSE 'answer' END AS part FROM r WHERE n <= CASE WHEN gone THEN 2 ELSE 4 END"""
)
def extractive_answer(spark, folder):
    """The passages of all objects that quote an answer to a question, current ones first, replaced ones aside."""
    rows = current_rows(table(spark, folder, "knowledge_object"), "title", "body", "state").filter("state <> 'deleted'")
    return X.answers(rows, "id", F.col("title"), F.col("body"), F.col("state"), _ASK).select(F.col("key").alias("id"), "pos", "sentence", "score", "part")


@query()
def chunk_keywords(spark, folder):
    """Ten keywords of each document, rarity counted over retrieval units."""
    docs = table(spark, folder, "documents")
    units = cut(C.chunk_texts(docs, "doc_id", "text").select("chunk"))
    return X.keywords(docs, "doc_id", F.col("text"), X.unit_frequency(units, "chunk"), units.count()).withColumnRenamed("key", "doc_id")


@query(r"""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def debounced_events(spark, folder):
    """Bursts of events of a user: a batch twin of the streaming debounce."""
    from lorestack.streaming.streams import debounce

    return debounce(table(spark, folder, "events"), "user_id", "ts", "30 minutes").select("user_id", "first_ts", "last_ts", "n")


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, CAST(round(sum(value), 3) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, folder):
    """Daily windows of events: a batch twin of the streaming aggregation."""
    from lorestack.streaming.streams import windowed_counts

    w = windowed_counts(table(spark, folder, "events"), "event_type", "ts", "1 day")
    return w.select("event_type", F.to_date("window.start").alias("day"), "n", F.round("total", 3).alias("total"))
