"""Queries of search as a whole, notices, context and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestack.operators import graph as G
from lorestack.operators import history as H
from lorestack.operators import recall as M
from lorestack.operators.search import parse_query
from lorestack.plans import duck
from lorestack.plans.base import Registry
from lorestack.plans.duck import EDGE, EVID, HEAD
from lorestack.plans.store import NOW, first_rows, ko
from lorestack.session import cut
from lorestack.sources.tables import current_rows, table

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL
_ASK = "harbour archive forecast measurement"
_COLUMNS = ("workspace_id", "kind", "title", "body", "attrs", "epistemic", "origin", "confidence", "review", "state", "superseded_by", "occurred_at", "created_at", "updated_at", "access_count", "last_access", "content_hash")


def store(spark, folder):
    rel = cut(G.active(G.edges(table(spark, folder, "relation"))))
    proof = first_rows(table(spark, folder, "evidence"), "id", "target_id", "stance")
    return M.Store(cut(current_rows(ko(spark, folder), *_COLUMNS)), rel, proof, NOW)


# hashed features of living objects and of a text, as (id, bucket, v)
_FEATURES = f"""t AS (SELECT id, unnest({duck.content("concat_ws(chr(10), title, body)")}) AS t FROM alive UNION ALL SELECT chr(1), unnest({duck.content(f"'{_ASK}'")})), w AS (SELECT id, t, 1 + ln(count(*)) AS w FROM t GROUP BY 1, 2),
f AS (SELECT id, 'w:' || t AS f, w FROM w UNION ALL SELECT id, 'g:' || unnest([substring('#' || t || '#', i, 3) for i in range(1, length(t) + 1)]), 0.28 * w FROM w), u AS (SELECT f, sha256(f) AS h FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT id, CAST('0x' || left(h, 8) AS BIGINT) % 256 AS bucket, sum(w * CASE WHEN h[9] IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 1 ELSE -1 END) AS v FROM f JOIN u USING (f) GROUP BY 1, 2), norm AS (SELECT id, sqrt(sum(v * v)) AS n FROM b GROUP BY 1)"""
_SEARCH = f"""{HEAD}, {EDGE}, {EVID}, alive AS (SELECT * FROM head WHERE state <> 'deleted'), {_FEATURES},
sem AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT *, max(s) OVER () AS top FROM (SELECT b.id, round(sum(b.v * q.v) / any_value(x.n) / any_value(y.n), 6) AS s FROM b JOIN b q ON q.id = chr(1) AND q.bucket = b.bucket JOIN norm x ON x.id = b.id JOIN norm y ON y.id = chr(1) WHERE b.id <> chr(1) GROUP BY 1) WHERE s >= 0.05) WHERE s >= 0.4 * top),
d AS (SELECT id, {duck.words('title')} AS a, {duck.words('body')} AS c FROM alive), size AS (SELECT count(*) AS n, avg(len(a) + len(c)) AS avg_len FROM d), qt AS (SELECT unnest(['harbour', 'archive', 'forecast', 'measurement']) AS q),
p AS (SELECT id, l, q, sum(w) AS w FROM (SELECT id, len(a) + len(c) AS l, unnest(a) AS term, 3 AS w FROM d UNION ALL SELECT id, len(a) + len(c), unnest(c), 1 FROM d) JOIN qt ON starts_with(term, q) GROUP BY 1, 2, 3), df AS (SELECT q, count(*) AS df FROM p GROUP BY 1),
lex AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * l / avg_len))), 6) AS s FROM p JOIN df USING (q), size GROUP BY 1)),
ru AS (SELECT id, 1e0 / (60 + rank) AS s FROM lex WHERE rank <= 100 UNION ALL SELECT id, 0.9e0 / (60 + rank) FROM sem WHERE rank <= 100), rrf AS (SELECT id, sum(s) AS s FROM ru GROUP BY 1),
deg AS (SELECT id, count(*) AS degree FROM (SELECT src_id AS id FROM edge WHERE state = 'active' AND src_id IS NOT NULL AND dst_id IS NOT NULL UNION ALL SELECT dst_id FROM edge WHERE state = 'active' AND src_id IS NOT NULL AND dst_id IS NOT NULL) GROUP BY 1), ev AS (SELECT target_id AS id, count(*) AS evidence FROM evid GROUP BY 1),
x AS (SELECT h.*, s, coalesce(degree, 0) AS degree, coalesce(evidence, 0) AS evidence FROM rrf JOIN alive h USING (id) LEFT JOIN deg USING (id) LEFT JOIN ev USING (id) WHERE state NOT IN ('archived', 'superseded')),
sc AS (SELECT id, title, s * ((CASE review WHEN 'confirmed' THEN 1.25e0 WHEN 'rejected' THEN 0.4e0 ELSE 1.0e0 END) * (CASE epistemic WHEN 'fact' THEN 1.15e0 WHEN 'observation' THEN 1.05e0 WHEN 'conclusion' THEN 1.05e0 WHEN 'inference' THEN 0.95e0 WHEN 'hypothesis' THEN 0.9e0 WHEN 'speculation' THEN 0.75e0 ELSE 1.0e0 END)
 * (CASE WHEN origin = 'user' THEN 1.1e0 WHEN origin = 'ai' AND review = 'unreviewed' THEN 0.85e0 ELSE 1.0e0 END) * coalesce(0.7e0 + 0.3e0 * confidence, 1.0e0) * (1 + least(0.2e0, 0.05e0 * evidence)))
 * (0.85e0 + 0.15e0 * pow(0.5e0, greatest(0, date_diff('day', CAST(updated_at AS DATE), DATE '2026-01-01')) / 180.0e0))
 * (0.85e0 + 0.3e0 * (0.32e0 * least(1.0e0, ln(1 + coalesce(access_count, 0)) / ln(41.0e0)) + coalesce(0.18e0 * pow(0.5e0, greatest(0, date_diff('day', CAST(last_access AS DATE), DATE '2026-01-01')) / 60.0e0), 0) + 0.25e0 * least(1.0e0, degree / 8) + 0.15e0 * least(1.0e0, evidence / 4) + (CASE WHEN review = 'confirmed' THEN 0.1e0 ELSE 0 END))) AS score FROM x)"""


@query(f"WITH {_SEARCH} SELECT id, title, floor(1e6 * score + 0.5) / 1e6 AS score, row_number() OVER (ORDER BY floor(1e6 * score + 0.5) DESC, id) AS rank FROM sc ORDER BY rank LIMIT 20")
def hybrid_search(spark, folder):
    """A search from text to ranked objects: words by prefix, hashed vectors, fusion, filters, quality, recency, salience."""
    return M.search(store(spark, folder), parse_query(_ASK, NOW)).select("id", "title", "score", "rank")


@query()
def reranked_search(spark, folder):
    """The same search near an anchor of the graph, reranked, with the reasons of each result."""
    s = store(spark, folder)
    hub = G.degrees(s.relations).orderBy(F.desc("degree"), "id").first()
    out = M.search(s, parse_query(_ASK, NOW), 10, anchor=hub.id if hub else None, rerank=True)
    return out.select("id", "score", "rank", "why.lexical", "why.semantic", "why.depth", "why.quality", F.array_join("why.because", ", ").alias("because"))


@query(
    f"""WITH {HEAD}, alive AS (SELECT * FROM head WHERE state <> 'deleted'), {_FEATURES}, s AS (SELECT q.id, b.id AS other, round(sum(b.v * q.v) / any_value(x.n) / any_value(y.n), 6) AS similarity FROM b q JOIN b ON q.bucket = b.bucket AND b.id <> q.id JOIN norm x ON x.id = b.id JOIN norm y ON y.id = q.id
 WHERE b.id <> chr(1) AND q.id <> chr(1) AND right(q.id, 1) = '0' GROUP BY 1, 2)
SELECT id, other, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM s WHERE similarity >= 0.35) WHERE rank <= 6"""
)
def similar_objects(spark, folder):
    """The six nearest objects of every object whose id ends in 0, by vectors of title and body."""
    s = store(spark, folder)
    return M.similar_to(s, s.heads.filter(F.right("id", F.lit(1)) == "0"))


@query(
    f"""WITH {HEAD}, {EDGE}, gone AS (SELECT id FROM head WHERE state = 'deleted'), e AS (SELECT * FROM edge WHERE state = 'active' AND src_id IS NOT NULL AND dst_id IS NOT NULL),
c AS (SELECT workspace_id, count(*) AS n FROM (SELECT DISTINCT workspace_id, least(src_id, dst_id), greatest(src_id, dst_id) FROM e WHERE type = 'contradicts' AND src_id NOT IN (FROM gone) AND dst_id NOT IN (FROM gone)) GROUP BY 1),
st AS (SELECT workspace_id, id, row_number() OVER (PARTITION BY workspace_id ORDER BY updated_at, id) AS k FROM head WHERE state = 'active' AND review = 'unreviewed' AND updated_at < TIMESTAMP '2025-01-01' AND (coalesce(title, '') GLOB '*[0-9]*' OR coalesce(body, '') GLOB '*[0-9]*')),
l AS (SELECT workspace_id, count(*) AS total, count(*) FILTER (WHERE id NOT IN (SELECT src_id FROM e WHERE type <> 'mentions' UNION SELECT dst_id FROM e WHERE type <> 'mentions')) AS n FROM head WHERE state = 'active' AND lower(trim(kind)) <> 'entity' GROUP BY 1)
SELECT workspace_id, 'open-conflicts' AS kind, NULL AS object_id, n, least(0.9e0, 0.5e0 + n * 0.1e0) AS strength FROM c UNION ALL SELECT workspace_id, 'possibly-outdated', id, 1, 0.5e0 FROM st WHERE k <= 5 UNION ALL SELECT workspace_id, 'unconnected', NULL, n, 0.45e0 FROM l WHERE total >= 20 AND n / total > 0.7"""
)
def workspace_notices(spark, folder):
    """What a workspace should be told: open disagreements, unchecked figures, unconnected knowledge."""
    return M.workspace_notices(store(spark, folder))


@query(
    f"""WITH {HEAD}, {EDGE}, h AS (SELECT id, title, review, created_at, state, list_distinct({duck.content("coalesce(title, '') || ' ' || coalesce(body, '')")}) AS t, list_distinct({duck.content('title')}) AS hd FROM head),
x AS (SELECT id, unnest(t) AS term FROM h WHERE state <> 'deleted'), c AS (SELECT a.id AS id, b.id AS other, count(*) AS n FROM x a JOIN x b ON a.term = b.term AND a.id <> b.id GROUP BY 1, 2),
o AS (SELECT c.id, c.other, n / (len(p.t) + len(q.t) - n) AS overlap, abs(epoch_us(p.created_at) - epoch_us(q.created_at)) / 86400e6 AS days, q.review, len(list_intersect(p.t, q.hd)) / (len(p.t) + len(q.hd) - len(list_intersect(p.t, q.hd))) AS ho FROM c JOIN h p ON p.id = c.id JOIN h q ON q.id = c.other WHERE n / (len(p.t) + len(q.t) - n) >= 0.45),
k AS (SELECT id, other, max(s) AS s FROM (SELECT src_id AS id, dst_id AS other, greatest(0.6e0, coalesce(confidence, 0.6e0)) AS s FROM edge WHERE type = 'contradicts' AND state = 'active' AND src_id IS NOT NULL AND dst_id IS NOT NULL UNION ALL SELECT dst_id, src_id, greatest(0.6e0, coalesce(confidence, 0.6e0)) FROM edge WHERE type = 'contradicts' AND state = 'active' AND src_id IS NOT NULL AND dst_id IS NOT NULL) GROUP BY 1, 2),
every AS (SELECT id, 'seen-before' AS kind, other, least(0.95e0, overlap + CASE WHEN days > 90 THEN 0.1e0 ELSE 0e0 END) AS strength, days FROM o UNION ALL SELECT id, 'contradiction', other, s, NULL FROM k WHERE id IN (SELECT id FROM o) UNION ALL SELECT id, 'previously-rejected', other, 0.75e0, days FROM o WHERE review = 'rejected' AND ho >= 0.5)
SELECT id, kind, other, floor(1e4 * strength + 0.5) / 1e4 AS strength, CAST(floor(days) AS BIGINT) AS age_days FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY strength DESC, kind, other) AS n FROM every) WHERE n <= 5"""
)
def object_notices(spark, folder):
    """What to tell of each object that overlaps with another: seen before, contradicted, once rejected."""
    s = store(spark, folder)
    return M.object_notices(s, cut(M.near_pairs(s)))


@query(
    f"""WITH {HEAD}, ids AS (SELECT id FROM head WHERE right(id, 1) IN ('0', '1')), r AS (SELECT h.title, n.id AS nid, n.title AS newer FROM head h JOIN head n ON n.id = h.superseded_by WHERE h.id IN (FROM ids)), a AS (SELECT abs(epoch(TIMESTAMP '2026-01-01') - epoch(max(coalesce(occurred_at, created_at)))) / 86400 AS days FROM head WHERE id IN (FROM ids))
SELECT * FROM (SELECT 'superseded-source' AS kind, nid AS object_id, 0.7e0 AS strength, '"' || title || '" has been replaced by "' || newer || '".' AS message FROM r UNION ALL SELECT 'all-old', NULL, 0.55e0, 'Everything behind this answer is at least ' || CASE WHEN days / 365 < 1.75 THEN 'about a year' ELSE CAST(CAST(floor(days / 365 + 0.5) AS BIGINT) AS VARCHAR) || ' years' END || ' old.' FROM a WHERE days > 365) ORDER BY strength DESC, object_id LIMIT 3"""
)
def question_notices(spark, folder):
    """The three foremost notices about the objects whose ids end in 0 or 1, as if an answer rested on them."""
    s = store(spark, folder)
    return M.question_notices(s, s.heads.filter(F.right("id", F.lit(1)).isin("0", "1")))


_QUESTION = "What did we originally decide about the harbour archive forecast?"


@query()
def question_context(spark, folder):
    """The items of a question's context in order, within its budget."""
    ctx = M.context(store(spark, folder), _QUESTION)
    rows = [(n, i["id"], i["priority"], i["score"], i["tokens"], i["reason"]) for n, i in enumerate(ctx.items, 1)]
    return spark.createDataFrame(rows, "place int, id string, priority double, score double, tokens int, reason string")


@query()
def asked_question(spark, folder):
    """An answer quoted from memory, with citations and whether a model should be asked."""
    a = M.ask(store(spark, folder), _QUESTION)
    return spark.createDataFrame([(a["answer"], a["grounded"], a["confidence"], a["citations"], a["escalate"], len(a["notices"]))], "answer string, grounded boolean, confidence double, citations array<string>, escalate string, notices int")


@query()
def recall_bundles(spark, folder):
    """Everything there is on each superseded object."""
    s = store(spark, folder)
    d = first_rows(table(spark, folder, "derivation"), "id", "target_id", "method", "target_version")
    return M.recall_bundle(s, s.heads.filter("superseded_by is not null"), H.versions(ko(spark, folder), "title"), d)
