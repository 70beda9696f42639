"""Queries over the graph of relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.operators import graph as G
from lorestack.operators.components import connected_components
from lorestack.plans import duck
from lorestack.plans.base import Registry
from lorestack.plans.duck import EDGE, HEAD
from lorestack.sources.tables import current_rows, kind_key, table

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL
_ALL = EDGE[:-1].replace("edge AS (", "edge AS (SELECT * FROM (") + ") WHERE src_id IS NOT NULL AND dst_id IS NOT NULL)"
_E = _ALL[:-1] + " AND state = 'active')"
_DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT src_id AS id FROM edge UNION ALL SELECT dst_id FROM edge) GROUP BY 1)"
_HUBS = "hub AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 3)"
# Fixed values, written out apart from those of the engine.
_LABEL = """CASE type WHEN 'related_to' THEN 'related_to' WHEN 'similar_to' THEN 'similar_to' WHEN 'contradicts' THEN 'contradicts' WHEN 'causes' THEN 'caused_by' WHEN 'caused_by' THEN 'causes' WHEN 'part_of' THEN 'contains' WHEN 'contains' THEN 'part_of'
 WHEN 'precedes' THEN 'follows' WHEN 'follows' THEN 'precedes' WHEN 'supersedes' THEN 'superseded_by' WHEN 'superseded_by' THEN 'supersedes' WHEN 'derived_from' THEN 'derives' WHEN 'derives' THEN 'derived_from' ELSE type || ' (inbound)' END"""


def rel(spark, folder):
    return G.active(G.edges(table(spark, folder, "relation")))


def hubs(spark, folder, n=3):
    return G.degrees(rel(spark, folder)).orderBy(F.desc("degree"), "id").limit(n).select("id")


@query(
    f"""WITH {_E}, {HEAD}, {_DEG}, {_HUBS}, n AS (SELECT src_id AS id, dst_id AS other, type, type AS label, 'out' AS direction, confidence FROM edge WHERE src_id IN (SELECT id FROM hub) UNION ALL SELECT dst_id, src_id, type, {_LABEL}, 'in', confidence FROM edge WHERE dst_id IN (SELECT id FROM hub))
SELECT * FROM n WHERE other IN (SELECT id FROM head WHERE state <> 'deleted') AND (confidence IS NULL OR confidence >= 0.3)"""
)
def neighbours(spark, folder):
    """Edges of the three foremost hubs to objects that aren't deleted, as seen from them."""
    nodes = current_rows(table(spark, folder, "knowledge_object"), "state")
    return G.neighbours(rel(spark, folder), hubs(spark, folder), nodes, 0.3)


@query(f"WITH {_E}, {HEAD} SELECT e.id, a.title AS src_title, e.type, b.title AS dst_title FROM edge e JOIN head a ON a.id = e.src_id JOIN head b ON b.id = e.dst_id WHERE a.state <> 'deleted' AND b.state <> 'deleted'")
def edge_titles(spark, folder):
    nodes = current_rows(table(spark, folder, "knowledge_object"), "title", "state").filter("state <> 'deleted'")
    e = rel(spark, folder).select("id", "type", "src_id", "dst_id")
    for side in ("src", "dst"):
        e = e.join(nodes.select(F.col("id").alias(f"{side}_id"), F.col("title").alias(f"{side}_title")), f"{side}_id")
    return e.select("id", "src_title", "type", "dst_title")


@query(f"WITH {_E}, {_DEG} SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) AS rank FROM deg ORDER BY rank LIMIT 100")
def degree_rank(spark, folder):
    from pyspark.sql import Window

    top = G.degrees(rel(spark, folder)).orderBy(F.desc("degree"), "id").limit(100)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))


@query(f"WITH {_E}, {HEAD} SELECT id FROM head WHERE state = 'active' AND id NOT IN (SELECT src_id FROM edge WHERE type <> 'mentions') AND id NOT IN (SELECT dst_id FROM edge WHERE type <> 'mentions')")
def unlinked_objects(spark, folder):
    """Active objects that no edge but a mention touches."""
    ends = rel(spark, folder).filter("type <> 'mentions'").select(F.explode(F.array("src_id", "dst_id")).alias("id"))
    return current_rows(table(spark, folder, "knowledge_object"), "state").filter("state = 'active'").join(ends, "id", "left_anti").select("id")


@query(
    f"""WITH {_E}, {_DEG}, {_HUBS}, both_ways AS (SELECT src_id AS a, dst_id AS b FROM edge UNION SELECT dst_id, src_id FROM edge), one AS (SELECT DISTINCT b AS id FROM both_ways WHERE a IN (SELECT id FROM hub) AND b NOT IN (SELECT id FROM hub)),
two AS (SELECT DISTINCT b AS id FROM both_ways WHERE a IN (SELECT id FROM one) AND b NOT IN (SELECT id FROM one) AND b NOT IN (SELECT id FROM hub))
SELECT id, 0 AS depth FROM hub UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two"""
)
def reach_two_steps(spark, folder):
    return G.reach(rel(spark, folder), hubs(spark, folder), 2).select("id", "depth")


@query(
    f"""WITH {_E}, c AS (SELECT *, CASE origin WHEN 'user' THEN 3 WHEN 'source' THEN 2 ELSE 1 END AS trust FROM edge WHERE src_id <> dst_id), r AS (SELECT *, row_number() OVER (PARTITION BY src_id, type, dst_id ORDER BY trust DESC, updated_at DESC, id DESC) AS n, count(*) OVER (PARTITION BY src_id, type, dst_id) AS asserted FROM c)
SELECT src_id, type, dst_id, id, origin, confidence, asserted FROM r WHERE n = 1"""
)
def settled_edges(spark, folder):
    """One edge for each pair and type, of the most trusted origin."""
    return G.settle(rel(spark, folder))


@query(
    f"""WITH {_E}, {HEAD}, n AS (SELECT id, min(id) OVER (PARTITION BY workspace_id, {duck.canonical('title')}) AS "into" FROM head WHERE lower(trim(kind)) = 'entity')
SELECT DISTINCT coalesce(a."into", src_id) AS src_id, type, coalesce(b."into", dst_id) AS dst_id FROM edge LEFT JOIN n a ON a.id = src_id LEFT JOIN n b ON b.id = dst_id WHERE coalesce(a."into", src_id) <> coalesce(b."into", dst_id)"""
)
def merged_edges(spark, folder):
    """Edges once entities of one workspace and canonical name are merged into the first."""
    rows = current_rows(table(spark, folder, "knowledge_object"), "workspace_id", "kind", "title").filter(kind_key() == "entity")
    named = rows.select("id", "workspace_id", T.canonicalise(F.col("title")).alias("name"))
    first = named.groupBy("workspace_id", "name").agg(F.min("id").alias("into"))
    mapping = named.join(first, ["workspace_id", "name"]).select("id", "into")
    return G.merge_nodes(rel(spark, folder), mapping)


@query(f"WITH {_E}, {_DEG}, top AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 60) SELECT id, src_id, type, dst_id FROM edge WHERE src_id IN (SELECT id FROM top) AND dst_id IN (SELECT id FROM top)")
def induced_subgraph(spark, folder):
    e = rel(spark, folder).select("id", "src_id", "type", "dst_id")
    top = hubs(spark, folder, 60)
    for side in ("src_id", "dst_id"):
        e = e.join(top.withColumnRenamed("id", side), side, "left_semi")
    return e.select("id", "src_id", "type", "dst_id")


@query(f"WITH {_E}, {HEAD} SELECT h.id, h.title, count(*) AS mentions FROM edge e JOIN head h ON h.id = e.dst_id WHERE e.type = 'mentions' AND lower(trim(h.kind)) = 'entity' AND h.state <> 'deleted' GROUP BY 1, 2 ORDER BY mentions DESC, h.title, h.id LIMIT 100")
def entity_mentions(spark, folder):
    """The hundred most mentioned entities."""
    e = rel(spark, folder).filter("type = 'mentions'").groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("mentions"))
    rows = current_rows(table(spark, folder, "knowledge_object"), "kind", "title", "state").filter((kind_key() == "entity") & (F.col("state") != "deleted"))
    return rows.join(e, "id").select("id", "title", "mentions").orderBy(F.desc("mentions"), "title", "id").limit(100)


@query(
    f"""WITH RECURSIVE {_E}, both_ways AS (SELECT src_id AS a, dst_id AS b FROM edge WHERE type = 'supersedes' OR type = 'part_of' UNION SELECT dst_id, src_id FROM edge WHERE type = 'supersedes' OR type = 'part_of'),
walk AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT walk.node, b FROM walk JOIN both_ways ON a = other) SELECT node, min(other) AS component FROM walk GROUP BY 1"""
)
def component_of_parts(spark, folder):
    """Connected components of the graph of parts and replacements."""
    return connected_components(rel(spark, folder).filter("type in ('supersedes', 'part_of')"), "src_id", "dst_id")


@query(f"WITH {_E} SELECT type, {_LABEL} AS inverse, count(*) AS n FROM edge GROUP BY 1, 2")
def relation_types(spark, folder):
    return rel(spark, folder).groupBy("type", G.other_label(F.col("type")).alias("inverse")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_ALL}, old AS (SELECT * FROM edge WHERE ingested_at <= TIMESTAMP '2025-07-01'), c AS (SELECT *, CASE origin WHEN 'user' THEN 3 WHEN 'source' THEN 2 ELSE 1 END AS t FROM old WHERE state = 'active'),
there AS (SELECT src_id, type, dst_id, max({{'t': t, 'eid': id, 'v': head_version, 'c': confidence}}) AS e FROM c GROUP BY 1, 2, 3),
n AS (SELECT src_id, type, dst_id, id, confidence, created_at, CASE origin WHEN 'user' THEN 3 WHEN 'source' THEN 2 ELSE 1 END AS t FROM edge WHERE ingested_at > TIMESTAMP '2025-07-01'),
h AS (SELECT n.*, e, max(CASE WHEN n.src_id <> n.dst_id THEN n.t END) OVER (PARTITION BY src_id, type, dst_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n LEFT JOIN there USING (src_id, type, dst_id))
SELECT id AS assertion, CASE WHEN src_id = dst_id THEN 'invalid' WHEN greatest(e.t, before) IS NULL THEN 'created' WHEN t < greatest(e.t, before) THEN 'blocked' ELSE 'reinforced' END AS outcome FROM h"""
)
def edge_assertions(spark, folder):
    """What becomes of the relations asserted after an instant, against those that were active before."""
    every = G.edges(table(spark, folder, "relation"))
    edge = F.lit("2025-07-01").cast("timestamp_ntz")
    new = every.filter(F.col("ingested_at") > edge).withColumn("at", F.col("created_at"))
    return G.assert_edges(every.filter(F.col("ingested_at") <= edge), new.select("id", "src_id", "type", "dst_id", "origin", "confidence", "at")).select("assertion", "outcome")


@query(
    f"""WITH {_ALL}, p AS (SELECT DISTINCT target_id AS id, CASE WHEN right(id, 1) IN ('0', '1', '2', '3', '4') THEN 'retract' WHEN right(id, 1) IN ('5', '6', '7', '8') THEN 'confirm' ELSE 'update' END AS action FROM evidence WHERE target_kind = 'relation')
SELECT p.id, action, CASE WHEN e.id IS NULL THEN 'missing' WHEN action = 'retract' AND state IS DISTINCT FROM 'retracted' OR action = 'confirm' AND review IS DISTINCT FROM 'confirmed' THEN 'changed' ELSE 'unchanged' END AS outcome FROM p LEFT JOIN edge e ON e.id = p.id"""
)
def edge_changes(spark, folder):
    """Versioned changes to relations: retractions, confirmations and updates without a new value."""
    last = F.right("id", F.lit(1))
    action = F.when(last.isin(*"01234"), "retract").when(last.isin(*"5678"), "confirm").otherwise("update")
    p = table(spark, folder, "evidence").filter("target_kind = 'relation'").select(F.col("target_id").alias("id"), action.alias("action")).distinct()
    rows = []
    for name in ("retract", "confirm", "update"):
        one = G.change_edges(G.edges(table(spark, folder, "relation")), p.filter(F.col("action") == name).withColumn("confidence", F.lit(None).cast("double")))
        rows.append(one.select("id", F.lit(name).alias("action"), "outcome"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    f"""WITH {HEAD}, {_E}, n AS (SELECT id, title, CAST(json_extract_string(attrs, '$.aliases[*]') AS VARCHAR[]) AS aliases, min(id) OVER (PARTITION BY workspace_id, {duck.canonical('title')}) AS "into" FROM head WHERE lower(trim(kind)) = 'entity'),
m AS (SELECT dst_id AS id, count(*) AS mentions FROM edge WHERE type = 'mentions' GROUP BY 1), x AS (SELECT n.*, coalesce(mentions, 0) AS mentions FROM n LEFT JOIN m USING (id)), own AS (SELECT id, title FROM n)
SELECT x."into" AS id, CAST(sum(mentions) AS BIGINT) AS mentions, count(*) FILTER (WHERE x.id <> x."into") AS merged, list_sort(list_distinct([a for a in list_concat(flatten(list(coalesce(aliases, []))), list(x.title) FILTER (WHERE x.id <> x."into")) if a IS NOT NULL AND a <> any_value(own.title)])) AS aliases
FROM x JOIN own ON own.id = x."into" GROUP BY x."into" """
)
def merged_entities(spark, folder):
    """Entities after those of one workspace and canonical name are merged: names united, mentions added up."""
    rows = current_rows(table(spark, folder, "knowledge_object"), "workspace_id", "kind", "title", "attrs").filter(kind_key() == "entity")
    named = rows.select("id", "workspace_id", "title", F.from_json(F.get_json_object("attrs", "$.aliases"), "array<string>").alias("aliases"), T.canonicalise(F.col("title")).alias("name"))
    first = named.groupBy("workspace_id", "name").agg(F.min("id").alias("into"))
    m = rel(spark, folder).filter("type = 'mentions'").groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("mentions"))
    mapping = named.join(first, (named.workspace_id.eqNullSafe(first.workspace_id)) & (named.name.eqNullSafe(first.name))).select("id", "into")
    return G.merge_entities(named.select("id", "title", "aliases").join(m, "id", "left"), mapping).select("id", "mentions", F.col("merged").cast("long").alias("merged"), F.col("aliases"))
