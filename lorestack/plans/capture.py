"""Queries of indexing, mentions and proposals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.operators import capture as C
from lorestack.operators import entities as E
from lorestack.operators import history as H
from lorestack.operators import mining as M
from lorestack.operators.search import browse, parse_query
from lorestack.plans import duck
from lorestack.plans.base import Registry
from lorestack.plans.duck import HEAD
from lorestack.plans.store import NOW, ko
from lorestack.sources import readers
from lorestack.sources.tables import current_rows, kind_key, table

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL


@query()
def text_chunks(spark, folder):
    """Retrieval units of all documents."""
    return C.chunk_texts(table(spark, folder, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "seq", "chunk", "tokens", "offset", "hash")


@query()
def parsed_sources(spark, folder):
    """Every source text read by the media type of its address: title, length of the text, headings, links and rows."""
    rows = table(spark, folder, "source_item").groupBy("id").agg(F.min(F.struct("ingested_at", "uri", "media_type", "text")).alias("r"))
    typed = rows.select("id", "r.text", F.coalesce(readers.media_type(F.col("r.uri")), "r.media_type").alias("kind"))
    return readers.parse_texts(typed, "id", "text", "kind").select(F.col("key").alias("id"), "title", F.length("text").alias("chars"), "headings", "links", "rows")


@query()
def name_spans(spark, folder):
    return C.extract_names(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


_CHUNK = "(SELECT id, s, substring(t, CAST(s * 360 + 1 AS BIGINT), 400) AS c FROM (SELECT id, t, unnest(range(0, CAST(greatest(1, ceil((length(t) - 40) / 360)) AS BIGINT))) AS s FROM (SELECT id, body AS t FROM {v} WHERE length(body) > 0)))"


@query(
    f"""WITH old AS (SELECT id, arg_min(body, (-head_version, ingested_at)) AS body FROM knowledge_object WHERE ingested_at <= TIMESTAMP '2025-06-01' GROUP BY 1), {HEAD},
a AS (SELECT DISTINCT id, sha256(c) AS h FROM {_CHUNK.format(v='old')}), b AS (SELECT DISTINCT id, sha256(c) AS h FROM {_CHUNK.format(v='head')})
SELECT CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'stale' ELSE 'kept' END AS change, count(*) AS n FROM a FULL JOIN b ON a.id = b.id AND a.h = b.h GROUP BY 1"""
)
def index_changes(spark, folder):
    """Chunks that an index of June keeps, loses and gains when it is brought up to date."""
    old = H.as_of(ko(spark, folder).filter("body is not null"), "2025-06-01 00:00:00", "body")
    new = current_rows(ko(spark, folder), "body")
    delta = C.index_delta(C.stride_chunks(old, "id", F.col("body")), C.stride_chunks(new, "id", F.col("body")))
    return delta.groupBy("change").agg(F.count("*").alias("n"))


@query(
    f"""WITH {HEAD}, w AS (SELECT id, workspace_id, ' ' || array_to_string({duck.words("concat_ws(' ', title, body)")}, '  ') || ' ' AS w FROM head),
n AS (SELECT DISTINCT id AS entity_id, workspace_id, ' ' || array_to_string({duck.words('title')}, '  ') || ' ' AS name FROM head WHERE lower(trim(kind)) = 'entity' AND len({duck.words('title')}) > 0)
SELECT id, entity_id, CAST((length(w) - length(replace(w, name, ''))) / length(name) AS BIGINT) AS n FROM w JOIN n USING (workspace_id) WHERE id <> entity_id AND contains(w, name)"""
)
def entity_mention_links(spark, folder):
    """Which objects name which entities of their workspace, by titles and aliases of any number of words."""
    rows = current_rows(ko(spark, folder), "workspace_id", "kind", "title", "body", "attrs")
    entities = rows.filter(kind_key() == "entity").select("id", "workspace_id", "title", F.from_json(F.get_json_object("attrs", "$.aliases"), "array<string>").alias("aliases"))
    return E.mentions(rows.select("id", "workspace_id", F.concat_ws(" ", "title", "body").alias("text")), entities)


@query(
    f"""WITH {HEAD}, s AS (SELECT id, list_distinct({duck.content('title')}) AS t FROM head WHERE lower(trim(kind)) <> 'entity'), x AS (SELECT id, unnest(t) AS term FROM s), c AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM x a JOIN x b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2)
SELECT a AS id_a, b AS id_b, round(n / (len(p.t) + len(q.t) - n), 6) AS similarity FROM c JOIN s p ON p.id = a JOIN s q ON q.id = b WHERE n / (len(p.t) + len(q.t) - n) >= 0.8"""
)
def similar_titles(spark, folder):
    """Pairs of objects whose titles share at least 80 % of their terms."""
    rows = current_rows(ko(spark, folder), "kind", "title").filter(kind_key() != "entity").select("id", T.content_terms(F.col("title")).alias("t"))
    return C.jaccard_join(rows, "id", "t", 0.8).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {HEAD} SELECT id, title, coalesce(occurred_at, created_at) AS moment FROM head WHERE lower(trim(kind)) IN ('note', 'decision') AND origin = 'user' AND state NOT IN ('deleted', 'archived', 'superseded') AND coalesce(occurred_at, created_at) >= TIMESTAMP '2025-03-01' AND coalesce(occurred_at, created_at) < TIMESTAMP '2025-10-31 23:59:59.9991' ORDER BY moment DESC, id LIMIT 80")
def filter_browse(spark, folder):
    """A query of filters alone, from text to plan."""
    intent = parse_query("kind:note kind:decision origin:user after:2025-03 before:2025-10", NOW)
    rows = current_rows(ko(spark, folder), "kind", "origin", "epistemic", "state", "review", "attrs", "occurred_at", "created_at", "title")
    return browse(rows, intent, 80).select("id", "title", F.coalesce("occurred_at", "created_at").alias("moment"))


# Fixed values, written out apart from those of the engine: words that don't begin or end a concept.
_NOISE = (
    "done get got make made use used using go going went really quite still only even never always often rather simply merely good bad big small cannot cant wont ought need needs want wants name names user users "
    "thing things way ways part case cases kind kinds type types item items goes run runs clone add adds set sets put puts take takes give gives keep keeps call calls see sees says say let lets true false null none"
).split()
_EDGE = ", ".join(f"'{w}'" for w in [*duck.STOPWORDS, *_NOISE])
_PROSE = "coalesce(title, '') || '. ' || coalesce(body, '')"
for _p in (r"(?m)^\s*\|.*\|\s*$", r"(?s)```.*?```", r"`[^`]*`", r"(?i)\bhttps?://\S+", r"\b[\w.-]+@[\w.-]+\.\w+", r"\b[\w.-]*\/[\w./-]+", r"(?i)\b[\w-]+\.(js|ts|md|json|sh|py|c|h|html|yml|yaml|toml)\b"):
    _PROSE = f"regexp_replace({_PROSE}, '{_p}', ' ', 'g')"


@query(
    f"""WITH {HEAD}, d AS (SELECT id, workspace_id, {duck.tokens(_PROSE)} AS w FROM head WHERE state = 'active' AND lower(trim(kind)) <> 'entity' AND review IS DISTINCT FROM 'rejected'), tot AS (SELECT workspace_id, count(*) AS total FROM d GROUP BY 1),
g AS (SELECT id, workspace_id, unnest(list_concat([w[i : i + 1] for i in range(1, len(w))], [w[i : i + 2] for i in range(1, len(w) - 1)])) AS x FROM d),
ok AS (SELECT id, workspace_id, array_to_string(x, ' ') AS phrase FROM g WHERE len(x) >= 2 AND len([t for t in x if length(t) < 3 OR regexp_matches(t, '[-._/]|[0-9]')]) = 0 AND x[1] NOT IN ({_EDGE}) AND x[-1] NOT IN ({_EDGE})),
c AS (SELECT workspace_id, phrase, count(DISTINCT id) AS documents, count(*) AS occurrences FROM ok GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3), taken AS (SELECT DISTINCT workspace_id, {duck.canonical('title')} AS phrase FROM head WHERE lower(trim(kind)) = 'entity'),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.workspace_id = c.workspace_id AND t.phrase = c.phrase))
SELECT workspace_id, phrase, documents, occurrences, floor(100 * (0.45e0 + 0.25e0 * (0.7e0 * least(1, documents / 8) + 0.3e0 * least(1, 3 * documents / total))) + 0.5) / 100 AS confidence FROM f JOIN tot USING (workspace_id)
 WHERE NOT EXISTS (SELECT 1 FROM f k WHERE k.workspace_id = f.workspace_id AND length(k.phrase) > length(f.phrase) AND contains(k.phrase, f.phrase) AND k.documents >= f.documents)"""
)
def concept_phrases(spark, folder):
    """Phrases of two and three words that recur in a workspace: no names of entities, nothing that a longer phrase of as
    many objects contains."""
    rows = current_rows(ko(spark, folder), "workspace_id", "kind", "title", "body", "state", "review", "attrs")
    return M.concepts(rows)
