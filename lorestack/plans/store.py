"""Queries over the store: lists, history, provenance, accounts and exchange, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorestack.operators import history as H
from lorestack.operators import lifecycle as L
from lorestack.plans.base import Registry
from lorestack.plans.duck import EDGE, EVID, HEAD, RUNS
from lorestack.session import lookup_join
from lorestack.sources import readers
from lorestack.sources.exchange import TABLES
from lorestack.sources.tables import current_rows, kind_key, table

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL
#: The instant that stands for now.
NOW = "2026-01-01 00:00:00"


def ko(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "knowledge_object")


def first_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Each record of a table whose deliveries differ in their landing only: its first delivery."""
    return df.groupBy("id").agg(F.min(F.struct("ingested_at", *[c for c in columns if c not in ("id", "ingested_at")])).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in columns if c != "id"])


@query(f"WITH {HEAD} SELECT id, title, state, updated_at FROM head WHERE lower(trim(kind)) IN ('note', 'fact') AND state = 'active' AND (confidence IS NULL OR confidence >= 0.3) ORDER BY updated_at DESC, id LIMIT 50 OFFSET 10")
def object_list(spark, folder):
    """A page of objects by kinds, state and least confidence (null passes), newest first."""
    rows = current_rows(ko(spark, folder), "kind", "title", "state", "confidence", "updated_at")
    rows = rows.filter(kind_key().isin("note", "fact") & (F.col("state") == "active") & (F.col("confidence").isNull() | (F.col("confidence") >= 0.3)))
    return rows.select("id", "title", "state", "updated_at").orderBy(F.desc("updated_at"), "id").offset(10).limit(50)


@query(f"WITH {HEAD} SELECT lower(trim(kind)) AS kind, state, origin, count(*) AS n FROM head GROUP BY 1, 2, 3")
def object_counts(spark, folder):
    return current_rows(ko(spark, folder), "kind", "state", "origin").groupBy(kind_key().alias("kind"), "state", "origin").agg(F.count("*").alias("n"))


@query(f"WITH {HEAD}, ask AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS pos FROM (SELECT DISTINCT id FROM knowledge_object ORDER BY id DESC LIMIT 30)) SELECT pos, id, title FROM ask JOIN head USING (id)")
def multi_get(spark, folder):
    """Objects of a list of ids in the order asked for; unknown ids are left out."""
    objects = ko(spark, folder)
    ask = objects.select("id").distinct().orderBy(F.desc("id")).limit(30).select(F.row_number().over(Window.orderBy(F.desc("id"))).alias("pos"), "id")
    return ask.join(current_rows(objects, "title"), "id").select("pos", "id", "title")


@query("SELECT DISTINCT ON (id) id, uri, media_type, title, byte_size, captured_at FROM source_item QUALIFY dense_rank() OVER (ORDER BY captured_at DESC, id) <= 50")
def source_list(spark, folder):
    rows = first_rows(table(spark, folder, "source_item"), "id", "uri", "media_type", "title", "byte_size", "captured_at")
    return rows.orderBy(F.desc("captured_at"), "id").limit(50)


@query(
    "WITH s AS (SELECT id, sha256(concat_ws(chr(31), media_type, coalesce(uri, ''), text)) AS h, min(captured_at) AS c FROM source_item WHERE length(text) > 0 GROUP BY 1, 2), k AS (SELECT h, arg_min(id, (c, id)) AS kept FROM s GROUP BY 1 HAVING count(*) > 1) SELECT id, kept FROM s JOIN k USING (h) WHERE id <> kept"
)
def source_duplicates(spark, folder):
    """Sources captured again with the same media type, address and text, and the first of each."""
    rows = table(spark, folder, "source_item").filter("length(text) > 0")
    hashed = rows.select("id", "captured_at", H.content_hash(F.col("media_type"), F.col("uri"), F.col("text")).alias("h")).groupBy("id", "h").agg(F.min("captured_at").alias("c"))
    kept = hashed.groupBy("h").agg(F.min(F.struct("c", "id")).alias("k"), F.count("*").alias("n")).filter("n > 1").select("h", F.col("k.id").alias("kept"))
    return hashed.join(kept, "h").filter("id <> kept").select("id", "kept")


@query(
    r"""WITH s AS (SELECT DISTINCT id, uri FROM source_item), e AS (SELECT id, lower(regexp_extract(regexp_replace(uri, '[?#].*$', ''), '\.([A-Za-z0-9]+)$', 1)) AS ext FROM s)
SELECT CASE ext WHEN 'md' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain' WHEN 'html' THEN 'text/html' WHEN 'json' THEN 'application/json' WHEN 'csv' THEN 'text/csv' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'eml' THEN 'message/rfc822' END AS guessed, count(*) AS n FROM e GROUP BY 1"""
)
def media_types(spark, folder):
    rows = table(spark, folder, "source_item").select("id", "uri").distinct()
    return rows.groupBy(readers.media_type(F.col("uri")).alias("guessed")).agg(F.count("*").alias("n"))


@query(
    r"""WITH f AS (SELECT DISTINCT id, uri AS path, byte_size AS n FROM source_item WHERE starts_with(uri, 'file:'))
SELECT CASE WHEN NOT coalesce(lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) IN ('md', 'markdown', 'txt', 'html', 'htm', 'json', 'csv', 'pdf'), false) THEN 'unsupported type' WHEN n = 0 THEN 'empty' WHEN n > 4000 THEN 'too large' END AS reason, count(*) AS n FROM f GROUP BY 1"""
)
def skip_summary(spark, folder):
    """Why files would be skipped, counted; null: they are read."""
    rows = table(spark, folder, "source_item").filter(F.col("uri").startswith("file:")).select("id", F.col("uri").alias("path"), F.col("byte_size").alias("length")).distinct()
    return readers.plan_folder(rows, 4000).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "WITH s AS (SELECT id, uri, byte_size, content_hash, min(ingested_at) AS landed FROM source_item WHERE uri IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT id, uri FROM s a WHERE landed > TIMESTAMP '2025-07-01' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.landed <= TIMESTAMP '2025-07-01' AND b.uri = a.uri AND b.byte_size = a.byte_size AND b.content_hash = a.content_hash)"
)
def unseen_files(spark, folder):
    """Files that no source recorded by an instant has, by address, size and fingerprint."""
    s = table(spark, folder, "source_item").filter("uri is not null").groupBy("id", "uri", "byte_size", "content_hash").agg(F.min("ingested_at").alias("at"))
    edge = F.lit("2025-07-01").cast("timestamp_ntz")
    return s.filter(F.col("at") > edge).join(s.filter(F.col("at") <= edge), ["uri", "byte_size", "content_hash"], "left_anti").select("id", "uri")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, workspace_id, count(*) AS rows, count(DISTINCT id) AS ids FROM {t} GROUP BY 2" for t in ("knowledge_object", "relation", "evidence", "source_item", "derivation", "capability_run", "sync_peer")))
def export_manifest(spark, folder):
    """Rows and records of each table and workspace that an export holds."""
    out = None
    for name in TABLES:
        part = table(spark, folder, name).groupBy("workspace_id", "id").agg(F.count("*").alias("c")).groupBy("workspace_id").agg(F.sum("c").alias("rows"), F.count("*").alias("ids"))
        part = part.select(F.lit(name).alias("table_name"), "workspace_id", "rows", "ids")
        out = part if out is None else out.union(part)
    return out


@query(
    f"WITH {HEAD}, {EDGE} SELECT e.workspace_id, count(*) AS relations, count(*) FILTER (WHERE a.id IS NULL OR b.id IS NULL) AS dangling FROM edge e LEFT JOIN head a ON a.id = e.src_id AND a.workspace_id = e.workspace_id LEFT JOIN head b ON b.id = e.dst_id AND b.workspace_id = e.workspace_id GROUP BY 1"
)
def import_dangling(spark, folder):
    """Relations of each workspace and how many an import of it alone would drop, an end being missing in it."""
    nodes = current_rows(ko(spark, folder), "workspace_id")
    rel = first_rows(table(spark, folder, "relation"), "id", "workspace_id", "src_id", "dst_id")
    for side in ("src_id", "dst_id"):
        rel = rel.join(nodes.select(F.col("id").alias(side), "workspace_id", F.lit(1).alias(f"has_{side}")), [side, "workspace_id"], "left")
    missing = F.when(F.col("has_src_id").isNull() | F.col("has_dst_id").isNull(), 1).otherwise(0)
    return rel.groupBy("workspace_id").agg(F.count("*").alias("relations"), F.sum(missing).alias("dangling"))


@query(
    """WITH o AS (SELECT 'objects' AS stream, id, ingested_at FROM knowledge_object WHERE ingested_at > TIMESTAMP '2025-09-01' ORDER BY ingested_at, id LIMIT 400), r AS (SELECT 'relations' AS stream, id, ingested_at FROM relation WHERE ingested_at > TIMESTAMP '2025-09-01' ORDER BY ingested_at, id LIMIT 400)
SELECT * FROM o UNION ALL SELECT * FROM r"""
)
def change_feed(spark, folder):
    streams = {"objects": ko(spark, folder), "relations": table(spark, folder, "relation")}
    return H.change_feed(streams, dict.fromkeys(streams, ("2025-09-01 00:00:00", None)), 400)


@query("SELECT id, arg_min(title, (-head_version, ingested_at)) AS title, max(head_version) AS head_version FROM knowledge_object WHERE ingested_at <= TIMESTAMP '2025-08-01' GROUP BY id")
def as_of_lookup(spark, folder):
    """Objects as they were at an instant."""
    return H.as_of(ko(spark, folder), "2025-08-01 00:00:00", "title").select("id", "title", "head_version")


@query(
    """WITH v AS (SELECT DISTINCT ON (id, head_version) id, head_version, title, state, superseded_by, kind FROM knowledge_object ORDER BY id, head_version, ingested_at),
l AS (SELECT *, row_number() OVER w AS n, lag(title) OVER w AS t, lag(state) OVER w AS s, lag(superseded_by) OVER w AS b, lag(kind) OVER w AS k FROM v WINDOW w AS (PARTITION BY id ORDER BY head_version))
SELECT id, head_version, concat_ws(',', CASE WHEN title IS DISTINCT FROM t THEN 'title' END, CASE WHEN state IS DISTINCT FROM s THEN 'state' END, CASE WHEN superseded_by IS DISTINCT FROM b THEN 'superseded_by' END, CASE WHEN kind IS DISTINCT FROM k THEN 'kind' END) AS changed FROM l WHERE n > 1"""
)
def version_changes(spark, folder):
    return H.changes(ko(spark, folder), ["title", "state", "superseded_by", "kind"])


@query(
    f"""WITH {HEAD}, h AS (SELECT id, workspace_id, origin, created_at, concat_ws(chr(31), kind, trim(title), trim(coalesce(body, '')), attrs) AS h FROM head WHERE state IN ('active', 'archived') AND review IS DISTINCT FROM 'rejected'),
k AS (SELECT workspace_id, origin, h, arg_min(id, (created_at, id)) AS kept FROM h GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT id, kept FROM h JOIN k USING (workspace_id, origin, h) WHERE id <> kept"""
)
def content_duplicates(spark, folder):
    """Objects of a workspace and origin that say the same as an older one, and the oldest of each."""
    rows = current_rows(ko(spark, folder), "workspace_id", "origin", "kind", "title", "body", "attrs", "state", "review", "created_at").filter(F.col("state").isin("active", "archived") & ~F.coalesce(F.col("review") == "rejected", F.lit(False)))
    return H.duplicates(rows.withColumn("h", L.object_hash()), [F.col("h")], ["workspace_id", "origin"], "id", "created_at")


@query(f"WITH {HEAD} SELECT id, title, coalesce(occurred_at, created_at) AS moment FROM head WHERE state IN ('active', 'archived', 'superseded') ORDER BY moment DESC, id LIMIT 100")
def timeline(spark, folder):
    rows = current_rows(ko(spark, folder), "title", "state", "occurred_at", "created_at").filter(F.col("state").isin("active", "archived", "superseded"))
    return rows.select("id", "title", F.coalesce("occurred_at", "created_at").alias("moment")).orderBy(F.desc("moment"), "id").limit(100)


@query("SELECT event_id, ts, event_type, user_id FROM events WHERE event_type IN ('click', 'purchase', 'error') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 200")
def event_log(spark, folder):
    rows = table(spark, folder, "events").filter(F.col("event_type").isin("click", "purchase", "error") & (F.col("ts") >= "2024-01-05") & (F.col("ts") < "2024-01-20"))
    return rows.select("event_id", "ts", "event_type", "user_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)


@query("SELECT user_id, count(*) AS access_count, max(ts) AS last_access FROM events GROUP BY 1")
def access_counters(spark, folder):
    """Counters as an aggregate of access events."""
    return table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_access"))


@query(
    f"""WITH {EVID}, {HEAD}, src AS (SELECT DISTINCT ON (id) id, title FROM source_item), j AS (SELECT e.target_id, e.id, e.stance, e.weight, s.title AS source_title, o.title AS object_title,
 row_number() OVER (PARTITION BY e.target_id ORDER BY (e.stance = 'contradicts') DESC NULLS LAST, e.weight DESC NULLS LAST, e.created_at, e.id) AS n FROM evid e LEFT JOIN src s ON s.id = e.source_id LEFT JOIN head o ON o.id = e.object_id)
SELECT * FROM j WHERE n <= 3"""
)
def evidence_list(spark, folder):
    """The three foremost pieces of evidence of each target: contradicting first, then by weight and age."""
    e = first_rows(table(spark, folder, "evidence"), "id", "target_id", "stance", "weight", "created_at", "source_id", "object_id")
    own = Window.partitionBy("target_id").orderBy(F.desc_nulls_last(F.col("stance") == "contradicts"), F.desc_nulls_last("weight"), "created_at", "id")
    e = e.withColumn("n", F.row_number().over(own)).filter("n <= 3").drop("created_at")
    s = table(spark, folder, "source_item").groupBy(F.col("id").alias("source_id")).agg(F.min("title").alias("source_title"))
    o = current_rows(ko(spark, folder), "title").select(F.col("id").alias("object_id"), F.col("title").alias("object_title"))
    return e.join(s, "source_id", "left").join(o, "object_id", "left").select("target_id", "id", "stance", "weight", "source_title", "object_title", "n")


@query(f"WITH {HEAD} SELECT id, title FROM head WHERE id IN (SELECT target_id FROM evidence WHERE source_id IS NOT NULL)")
def sourced_objects(spark, folder):
    targets = table(spark, folder, "evidence").filter("source_id is not null").select(F.col("target_id").alias("id"))
    return current_rows(ko(spark, folder), "title").join(targets, "id", "left_semi")


@query("WITH d AS (SELECT DISTINCT ON (id) * FROM derivation ORDER BY id, ingested_at) SELECT target_id, id, method, target_version, row_number() OVER (PARTITION BY target_id ORDER BY target_version NULLS FIRST, created_at, id) AS step FROM d")
def provenance_chain(spark, folder):
    d = first_rows(table(spark, folder, "derivation"), "id", "target_id", "method", "target_version", "created_at")
    own = Window.partitionBy("target_id").orderBy(F.asc_nulls_first("target_version"), "created_at", "id")
    return d.select("target_id", "id", "method", "target_version", F.row_number().over(own).alias("step"))


@query(f"WITH {HEAD} SELECT a.id, a.title, b.id AS replaced_by, b.title AS new_title, b.state AS new_state FROM head a JOIN head b ON b.id = a.superseded_by")
def supersessions(spark, folder):
    rows = current_rows(ko(spark, folder), "title", "state", "superseded_by")
    new = rows.select(F.col("id").alias("replaced_by"), F.col("title").alias("new_title"), F.col("state").alias("new_state"))
    return rows.filter("superseded_by is not null").join(new, F.col("superseded_by") == F.col("replaced_by")).select("id", "title", "replaced_by", "new_title", "new_state")


@query(f"WITH {RUNS} SELECT provider, model, count(*) AS calls, CAST(coalesce(sum(cost_micros), 0) AS BIGINT) AS micros, count(*) FILTER (WHERE status <> 'ok') AS failures, CAST(round(avg(latency_ms)) AS BIGINT) AS latency FROM runs GROUP BY 1, 2")
def runs_by_provider(spark, folder):
    rows = first_rows(table(spark, folder, "capability_run"), "id", "provider", "model", "cost_micros", "status", "latency_ms")
    fails = F.sum(F.when(F.col("status") != "ok", 1).otherwise(0))
    return rows.groupBy("provider", "model").agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost_micros"), F.lit(0)).alias("micros"), fails.alias("failures"), F.round(F.avg("latency_ms")).cast("long").alias("latency"))


@query(f"WITH {RUNS} SELECT capability, CAST(started_at AS DATE) AS day, count(*) AS calls, CAST(coalesce(sum(cost_micros), 0) AS BIGINT) AS micros, count(*) FILTER (WHERE status <> 'ok') AS failures FROM runs GROUP BY GROUPING SETS ((1, 2), (1), ())")
def runs_by_day(spark, folder):
    """Calls, costs and failures by capability and day, by capability and in total, in one pass."""
    rows = first_rows(table(spark, folder, "capability_run"), "id", "capability", "started_at", "cost_micros", "status").withColumn("day", F.to_date("started_at"))
    fails = F.coalesce(F.sum(F.when(F.col("status") != "ok", 1).otherwise(0)), F.lit(0)).alias("failures")
    return rows.groupingSets([["capability", "day"], ["capability"], []], "capability", "day").agg(F.count("*").alias("calls"), F.coalesce(F.sum("cost_micros"), F.lit(0)).alias("micros"), fails)


@query(
    f"WITH {RUNS}, l AS (SELECT provider, capability, latency_ms, row_number() OVER (PARTITION BY provider, capability ORDER BY started_at DESC, id DESC) AS n FROM runs WHERE status IN ('ok', 'timeout') AND latency_ms IS NOT NULL) SELECT provider, capability, CAST(round(median(latency_ms)) AS BIGINT) AS latency, count(*) AS runs FROM l WHERE n <= 20 GROUP BY 1, 2 HAVING count(*) >= 3"
)
def median_latency(spark, folder):
    """Median latency of the last twenty runs of each provider and capability."""
    rows = first_rows(table(spark, folder, "capability_run"), "id", "provider", "capability", "latency_ms", "started_at", "status").filter("status in ('ok', 'timeout') and latency_ms is not null")
    own = Window.partitionBy("provider", "capability").orderBy(F.desc("started_at"), F.desc("id"))
    last = rows.withColumn("n", F.row_number().over(own)).filter("n <= 20")
    return last.groupBy("provider", "capability").agg(F.round(F.median("latency_ms")).cast("long").alias("latency"), F.count("*").alias("runs")).filter("runs >= 3")


@query(
    f"WITH {RUNS}, p AS (SELECT provider, capability, avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END) AS quality, avg(latency_ms) AS latency FROM runs GROUP BY 1, 2) SELECT capability, provider, row_number() OVER (PARTITION BY capability ORDER BY round(quality, 6) DESC, round(latency, 3) NULLS LAST, provider) AS rank FROM p WHERE provider IS NOT NULL"
)
def provider_ranking(spark, folder):
    """Providers of each capability by success, then speed."""
    rows = first_rows(table(spark, folder, "capability_run"), "id", "provider", "capability", "status", "latency_ms").filter("provider is not null")
    p = rows.groupBy("provider", "capability").agg(F.round(F.avg(F.when(F.col("status") == "ok", 1.0).otherwise(0.0)), 6).alias("q"), F.round(F.avg("latency_ms"), 3).alias("l"))
    return p.select("capability", "provider", F.row_number().over(Window.partitionBy("capability").orderBy(F.desc("q"), F.asc_nulls_last("l"), "provider")).alias("rank"))


@query(
    f"""WITH {HEAD}, c AS (SELECT workspace_id, confidence, count(*) AS n FROM head WHERE confidence IS NOT NULL GROUP BY 1, 2), t AS (SELECT workspace_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_values, arg_max(confidence, (n, -confidence)) AS modal, max(n) AS modal_n, CAST(sum(CASE WHEN confidence >= 0.7 THEN n ELSE 0 END) AS BIGINT) AS passing FROM c GROUP BY 1)
SELECT workspace_id, total, distinct_values, modal, round(modal_n / total, 6) AS share, total >= 10 AND modal_n / total >= 0.66 AS degenerate, passing FROM t"""
)
def confidence_distribution(spark, folder):
    """How confidences of a workspace spread: values, the commonest and its share, whether that says nothing, how many pass 0.7."""
    c = current_rows(ko(spark, folder), "workspace_id", "confidence").filter("confidence is not null").groupBy("workspace_id", "confidence").agg(F.count("*").alias("n"))
    t = c.groupBy("workspace_id").agg(
        F.sum("n").alias("total"), F.count("*").alias("distinct_values"), F.max(F.struct("n", (-F.col("confidence")).alias("c"))).alias("m"), F.sum(F.when(F.col("confidence") >= 0.7, F.col("n")).otherwise(0)).alias("passing")
    )
    share = F.col("m.n") / F.col("total")
    return t.select("workspace_id", "total", "distinct_values", (-F.col("m.c")).alias("modal"), F.round(share, 6).alias("share"), ((F.col("total") >= 10) & (share >= 0.66)).alias("degenerate"), "passing")


@query(f"WITH {EVID} SELECT target_kind, target_id, count(*) AS n, count(*) FILTER (WHERE stance = 'contradicts') AS against, max(weight) AS most FROM evid GROUP BY 1, 2")
def evidence_counts(spark, folder):
    e = first_rows(table(spark, folder, "evidence"), "id", "target_kind", "target_id", "stance", "weight")
    return e.groupBy("target_kind", "target_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("stance") == "contradicts", 1).otherwise(0)).alias("against"), F.max("weight").alias("most"))


@query(f"WITH {EVID}, s AS (SELECT target_id, count(*) FILTER (WHERE stance = 'supports') AS pro, count(*) FILTER (WHERE stance = 'contradicts') AS con FROM evid GROUP BY 1) SELECT target_id, pro, con FROM s WHERE pro > 0 AND con > 0")
def open_conflicts(spark, folder):
    """Targets with evidence on both sides."""
    e = first_rows(table(spark, folder, "evidence"), "id", "target_id", "stance")
    side = lambda s: F.sum(F.when(F.col("stance") == s, 1).otherwise(0))
    return e.groupBy("target_id").agg(side("supports").alias("pro"), side("contradicts").alias("con")).filter("pro > 0 and con > 0")


@query(
    """WITH v AS (SELECT id, head_version, ingested_at, sha256(concat_ws(chr(31), coalesce(title, ''), coalesce(body, ''))) AS h FROM knowledge_object),
a AS (SELECT id, max(head_version) AS v, arg_min(h, (-head_version, ingested_at)) AS h FROM v WHERE ingested_at <= TIMESTAMP '2025-08-01' GROUP BY 1), b AS (SELECT id, max(head_version) AS v, arg_min(h, (-head_version, ingested_at)) AS h FROM v WHERE ingested_at > TIMESTAMP '2025-04-01' GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.v IS NULL THEN 'insert' WHEN b.v IS NULL THEN 'keep' WHEN b.v > a.v THEN 'take' WHEN b.v < a.v THEN 'keep' WHEN a.h = b.h THEN 'skip' ELSE 'conflict' END AS decision FROM a FULL JOIN b ON a.id = b.id"""
)
def sync_decisions(spark, folder):
    """What a pull would do with each object of a replica that stopped in August from one that began in April."""
    rows = ko(spark, folder).select("id", "head_version", "ingested_at", H.content_hash(F.col("title"), F.col("body")).alias("hash"))
    local = H.as_of(rows, "2025-08-01 00:00:00", "hash")
    remote = H.as_of(rows.filter(F.col("ingested_at") > F.lit("2025-04-01").cast("timestamp_ntz")), "9999-01-01 00:00:00", "hash")
    return H.sync_decisions(local, remote)


@query(
    """WITH o AS (SELECT DISTINCT id, workspace_id, head_version FROM knowledge_object WHERE ingested_at > TIMESTAMP '2025-06-01')
SELECT DISTINCT p.id AS peer_id, o.id, o.head_version FROM o JOIN sync_peer p USING (workspace_id) WHERE NOT EXISTS (SELECT 1 FROM sync_receipt r WHERE r.peer_id = p.id AND r.object_id = o.id AND r.version = o.head_version AND r.status = 'committed')"""
)
def echo_removal(spark, folder):
    """Versions to send to each peer of a workspace, without those that this very peer holds."""
    out = ko(spark, folder).filter(F.col("ingested_at") > F.lit("2025-06-01").cast("timestamp_ntz")).select("id", "workspace_id", "head_version").distinct()
    peers = table(spark, folder, "sync_peer").select(F.col("id").alias("peer_id"), "workspace_id").distinct()
    told = table(spark, folder, "sync_receipt").filter("status = 'committed'").select("peer_id", F.col("object_id").alias("id"), F.col("version").alias("head_version"))
    return H.without_echo(lookup_join(out, peers, ["workspace_id"], spread=F.col("id")).select("peer_id", "id", "head_version"), told, ["peer_id", "id", "head_version"])


@query(
    f"""WITH {HEAD}, e AS (SELECT id, concat_ws(',', CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence' END, CASE WHEN trim(title) = '' OR length(title) > 500 THEN 'title' END, CASE WHEN state NOT IN ('active', 'archived', 'superseded', 'deleted') THEN 'state' END, CASE WHEN valid_until < valid_from THEN 'validity' END, CASE WHEN superseded_by = id THEN 'self' END) AS errors FROM head) SELECT id, errors FROM e WHERE errors <> ''"""
)
def validation_errors(spark, folder):
    """All rules that an object breaks."""
    rows = current_rows(ko(spark, folder), "confidence", "title", "state", "valid_from", "valid_until", "superseded_by")
    rules = {
        "confidence": (F.col("confidence") < 0) | (F.col("confidence") > 1), "title": (F.trim("title") == "") | (F.length("title") > 500),
        "state": ~F.col("state").isin("active", "archived", "superseded", "deleted"), "validity": F.col("valid_until") < F.col("valid_from"), "self": F.col("superseded_by") == F.col("id"),
    }
    return rows.select("id", F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])), ",").alias("errors")).filter("errors <> ''")


@query(
    f"""WITH {HEAD}, t AS (SELECT coalesce(occurred_at, created_at) AS moment FROM head), r AS (SELECT unnest(['this_week', 'last_week', 'this_month', 'this_year', '90_days']) AS name, unnest([TIMESTAMP '2025-12-28', TIMESTAMP '2025-12-21', TIMESTAMP '2026-01-01', TIMESTAMP '2026-01-01', TIMESTAMP '2025-10-03']) AS a, unnest([TIMESTAMP '2026-01-02', TIMESTAMP '2025-12-28', TIMESTAMP '2026-01-02', TIMESTAMP '2026-01-02', TIMESTAMP '2026-01-02']) AS b)
SELECT name, count(moment) AS n FROM r LEFT JOIN t ON moment >= a AND moment < b GROUP BY 1"""
)
def range_counts(spark, folder):
    """Objects in the ranges that words like 'last week' mean at the instant NOW."""
    from lorestack.operators.search import resolve_range

    rows = current_rows(ko(spark, folder), "occurred_at", "created_at").select(F.coalesce("occurred_at", "created_at").alias("at"))
    counts = []
    for name, phrase in (("this_week", "this week"), ("last_week", "last week"), ("this_month", "this month"), ("this_year", "this year"), ("90_days", "90 days ago")):
        a, b = resolve_range(phrase, NOW)
        counts.append((name, F.sum(F.when((F.col("at") >= F.lit(a).cast("timestamp_ntz")) & (F.col("at") <= F.lit(b).cast("timestamp_ntz")), 1).otherwise(0))))
    wide = rows.agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in counts])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n, _ in counts])).alias("r")).select("r.name", "r.n")


@query(
    f"WITH {HEAD}, gone AS (SELECT id FROM head WHERE state = 'deleted') SELECT 'relation' AS table_name, count(*) AS left_rows FROM relation WHERE src_id NOT IN (SELECT id FROM gone) AND (dst_id IS NULL OR dst_id NOT IN (SELECT id FROM gone)) UNION ALL SELECT 'evidence', count(*) FROM evidence WHERE target_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'derivation', count(*) FROM derivation WHERE target_id NOT IN (SELECT id FROM gone)"
)
def purge_counts(spark, folder):
    """Rows that remain once everything that hangs on deleted objects is purged."""
    gone = current_rows(ko(spark, folder), "state").filter("state = 'deleted'").select(F.col("id").alias("g"))
    out = None
    for name, keys in (("relation", ("src_id", "dst_id")), ("evidence", ("target_id",)), ("derivation", ("target_id",))):
        rows = table(spark, folder, name)
        for k in keys:
            rows = rows.join(gone, F.col(k) == F.col("g"), "left_anti")
        part = rows.agg(F.count("*").alias("left_rows")).select(F.lit(name).alias("table_name"), "left_rows")
        out = part if out is None else out.union(part)
    return out


@query(f"WITH {HEAD} SELECT id, json_extract_string(attrs, '$.entityType') AS entity_type, len(json_keys(attrs)) AS keys FROM head WHERE lower(trim(kind)) = 'entity'")
def entity_attributes(spark, folder):
    rows = current_rows(ko(spark, folder), "kind", "attrs").filter(kind_key() == "entity")
    return rows.select("id", F.get_json_object("attrs", "$.entityType").alias("entity_type"), F.size(F.json_object_keys("attrs")).cast("long").alias("keys"))
