"""Queries of versioned changes, events, permissions and accounts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.operators import accounts as A
from lorestack.operators import capture as C
from lorestack.operators import entities as E
from lorestack.operators import history as H
from lorestack.operators import lifecycle as L
from lorestack.plans import duck
from lorestack.plans.base import Registry
from lorestack.plans.duck import EDGE, EVID, HEAD, RUNS
from lorestack.plans.store import NOW, first_rows, ko
from lorestack.sources.tables import current_rows, kind_key, table

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL
_FIELDS = ("title", "body", "attrs", "epistemic", "confidence", "review", "state", "superseded_by", "valid_until")
_CHANGE = "CASE WHEN right(id, 1) IN ('0', '1') THEN 'confirm' WHEN right(id, 1) IN ('2', '3') THEN 'archive' WHEN right(id, 1) IN ('4', '5') THEN 'delete' WHEN right(id, 1) IN ('6', '7') THEN 'restore' WHEN right(id, 1) IN ('8', '9') THEN 'supersede' WHEN right(id, 1) IN ('a', 'b') THEN 'reject' ELSE 'edit' END"


def patches(spark, folder):
    """Changes made up of the evidence about objects: what each is follows from its id."""
    e = first_rows(table(spark, folder, "evidence"), "id", "target_kind", "target_id", "object_id", "excerpt", "weight", "created_at").filter("target_kind = 'object'")
    edit = lambda c: F.when(F.col("change") == "edit", c)
    rows = e.withColumn("change", F.expr(_CHANGE))
    return rows.select(
        F.col("id").alias("patch_id"), F.col("target_id").alias("id"), F.col("created_at").alias("at"), "change", edit(F.substring("excerpt", 1, 12)).alias("title"), F.lit(None).cast("string").alias("body"),
        F.lit(None).cast("string").alias("attrs"), F.lit(None).cast("string").alias("epistemic"), edit(F.col("weight") * 1.05).alias("confidence"), F.when(F.col("change") == "supersede", F.col("object_id")).alias("superseded_by"),
    )


_W = "(PARTITION BY id ORDER BY at_, patch_id ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"
_UP, _BEFORE = _W.format(end="CURRENT ROW"), _W.format(end="1 PRECEDING")
_FOLD = (
    f"""WITH {EVID}, {HEAD}, p AS (SELECT id AS patch_id, target_id AS id, created_at AS at_, change, CASE WHEN change = 'edit' THEN left(excerpt, 12) END AS title, CASE WHEN change = 'edit' THEN weight * 1.05 END AS confidence, CASE WHEN change = 'supersede' THEN object_id END AS superseded_by
 FROM (SELECT *, {_CHANGE} AS change FROM evid WHERE target_kind = 'object')),
j AS (SELECT p.*, h.head_version AS v, """
    + ", ".join(f"h.{c} AS o_{c}" for c in _FIELDS)
    + f""", coalesce(trim(p.title) = '' OR p.confidence < 0 OR p.confidence > 1 OR p.change = 'supersede' AND (p.superseded_by IS NULL OR p.superseded_by = p.id), false) AS bad FROM p LEFT JOIN head h ON h.id = p.id),
g AS (SELECT *, coalesce(last_value(CASE WHEN NOT bad AND change IN ('delete', 'restore') THEN change = 'delete' END IGNORE NULLS) OVER {_BEFORE}, o_state = 'deleted', false) AS gone FROM j),
k AS (SELECT *, v IS NOT NULL AND NOT bad AND (NOT gone OR change = 'restore') AS ok FROM g),
n AS (SELECT *, """
    + ", ".join(
        f"coalesce(last_value(CASE WHEN ok THEN {x} END IGNORE NULLS) OVER {_UP}, o_{c}) AS n_{c}"
        for c, x in {
            "title": "trim(title)", "confidence": "confidence", "review": "CASE change WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' END", "superseded_by": "superseded_by", "valid_until": "CASE WHEN change = 'supersede' THEN at_ END",
            "state": "CASE change WHEN 'archive' THEN 'archived' WHEN 'delete' THEN 'deleted' WHEN 'restore' THEN 'active' WHEN 'supersede' THEN 'superseded' END",
        }.items()
    )
    + " FROM k), s AS (SELECT *, ok AND ("
    + " OR ".join(f"n_{c} IS DISTINCT FROM lag(n_{c}, 1, o_{c}) OVER (PARTITION BY id ORDER BY at_, patch_id)" for c in ("title", "confidence", "review", "state", "superseded_by", "valid_until"))
    + f""") AS step FROM n)
SELECT id, patch_id, CASE WHEN v IS NULL THEN 'missing' WHEN bad THEN 'invalid' WHEN NOT ok THEN 'deleted' WHEN step THEN 'changed' ELSE 'unchanged' END AS outcome, CAST(v + sum(CASE WHEN step THEN 1 ELSE 0 END) OVER {_UP} AS INTEGER) AS head_version, n_title AS title, n_state AS state, n_review AS review, n_superseded_by AS superseded_by, n_confidence AS confidence FROM s"""
)


@query(_FOLD)
def applied_changes(spark, folder):
    """What becomes of edits, confirmations, deletions, restorations and replacements, each a version or not."""
    heads = current_rows(ko(spark, folder), "head_version", *_FIELDS)
    return L.apply_changes(heads, patches(spark, folder)).select("id", "patch_id", "outcome", "head_version", "title", "state", "review", "superseded_by", "confidence")


@query(
    f"""WITH {HEAD}, s AS (SELECT DISTINCT ON (id) * FROM source_item ORDER BY id, ingested_at), i AS (SELECT id AS input_id, workspace_id, origin, trim(title) AS title, captured_at AS at_, concat_ws(chr(31), 'note', trim(title), trim(coalesce(text, '')), '{{}}') AS h FROM s
 UNION ALL SELECT id, workspace_id, origin, trim(title), created_at, concat_ws(chr(31), kind, trim(title), trim(coalesce(body, '')), attrs) FROM head WHERE right(id, 1) IN ('0', '1', '2')),
e AS (SELECT workspace_id, origin, concat_ws(chr(31), kind, trim(title), trim(coalesce(body, '')), attrs) AS h, arg_min(id, (created_at, id)) AS known FROM head WHERE state IN ('active', 'archived') AND review IS DISTINCT FROM 'rejected' GROUP BY 1, 2, 3),
x AS (SELECT *, coalesce(title, '') = '' OR workspace_id IS NULL OR origin IS NULL AS bad FROM i), f AS (SELECT workspace_id, origin, h, arg_min(input_id, (at_, input_id)) AS first FROM x WHERE NOT bad GROUP BY 1, 2, 3)
SELECT input_id, CASE WHEN bad THEN 'invalid' WHEN known IS NOT NULL THEN 'existing' WHEN first = input_id THEN 'created' ELSE 'existing' END AS outcome, CASE WHEN NOT bad THEN coalesce(known, 'new_' || first) END AS id,
 CASE WHEN NOT bad THEN CASE WHEN origin IN ('ai', 'algorithm') THEN 'inference' ELSE 'observation' END END AS epistemic FROM x LEFT JOIN e USING (workspace_id, origin, h) LEFT JOIN f USING (workspace_id, origin, h)"""
)
def created_objects(spark, folder):
    """Sources and a part of the objects remembered again: what is created, what is there already, what can't be."""
    s = first_rows(table(spark, folder, "source_item"), "id", "workspace_id", "title", "text", "origin", "captured_at")
    heads = current_rows(ko(spark, folder), "workspace_id", "kind", "title", "body", "attrs", "origin", "state", "review", "created_at")
    new = s.select(F.col("id").alias("input_id"), "workspace_id", F.lit("note").alias("kind"), "title", F.col("text").alias("body"), F.lit("{}").alias("attrs"), "origin", F.col("captured_at").alias("at"))
    again = heads.filter(F.right("id", F.lit(1)).isin(*"012")).select(F.col("id").alias("input_id"), "workspace_id", "kind", "title", "body", "attrs", "origin", F.col("created_at").alias("at"))
    inputs = new.unionByName(again).withColumn("epistemic", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    return L.create(inputs, heads).select("input_id", "outcome", "id", "epistemic")


@query(
    """WITH v AS (SELECT DISTINCT ON (id, head_version) id, head_version, state, review FROM knowledge_object ORDER BY id, head_version, ingested_at), l AS (SELECT *, row_number() OVER w AS n, lag(state) OVER w AS s, lag(review) OVER w AS r FROM v WINDOW w AS (PARTITION BY id ORDER BY head_version))
SELECT id, head_version, CASE WHEN n = 1 THEN 'captured' WHEN state IS DISTINCT FROM s AND state = 'superseded' THEN 'superseded' WHEN state IS DISTINCT FROM s AND state = 'archived' THEN 'archived' WHEN state IS DISTINCT FROM s AND state = 'deleted' THEN 'deleted'
 WHEN state IS DISTINCT FROM s AND state = 'active' THEN 'restored' WHEN review IS DISTINCT FROM r AND review = 'confirmed' THEN 'confirmed' WHEN review IS DISTINCT FROM r AND review = 'rejected' THEN 'rejected' ELSE 'updated' END AS event FROM l"""
)
def version_events(spark, folder):
    return L.version_events(H.versions(ko(spark, folder), "state", "review", "superseded_by"))


@query(
    f"""WITH {EVID}, x AS (SELECT *, coalesce(trim(translate(target_id, chr(9), ' ')), '') = '' OR coalesce(target_kind NOT IN ('object', 'relation'), true) AS t, coalesce(trim(translate(source_id, chr(9), ' ')), '') = '' AND coalesce(trim(translate(object_id, chr(9), ' ')), '') = '' AS g FROM evid)
SELECT id, coalesce(stance, 'supports') AS stance, coalesce(weight, 1e0) AS weight, CASE WHEN t THEN 'target' WHEN g THEN 'ground' WHEN coalesce(stance, 'supports') NOT IN ('supports', 'contradicts', 'mentions') THEN 'stance' WHEN coalesce(weight, 1) NOT BETWEEN 0 AND 1 THEN 'weight' END AS error FROM x"""
)
def evidence_links(spark, folder):
    rows = first_rows(table(spark, folder, "evidence"), "id", "target_kind", "target_id", "source_id", "object_id", "stance", "weight")
    return L.link_evidence(rows).select("id", "stance", "weight", "error")


@query(
    f"""WITH {HEAD}, a AS (SELECT object_id AS id, count(*) AS n, max(received_at) AS at_ FROM sync_receipt GROUP BY 1) SELECT h.id, CAST(coalesce(access_count, 0) + coalesce(n, 0) AS BIGINT) AS access_count, greatest(last_access, at_) AS last_access FROM head h LEFT JOIN a ON a.id = h.id"""
)
def touched_objects(spark, folder):
    """Counters of objects after peers have fetched them."""
    rows = current_rows(ko(spark, folder), "access_count", "last_access")
    return L.touch(rows, table(spark, folder, "sync_receipt").select(F.col("object_id").alias("id"), F.col("received_at").alias("at")))


@query(
    f"""WITH {HEAD}, g AS (SELECT id AS principal, workspace_id, CASE WHEN right(id, 1) IN ('0', '1', '2', '3') THEN 1 WHEN right(id, 1) IN ('4', '5', '6', '7') THEN 2 ELSE 3 END AS l FROM sync_peer),
og AS (SELECT peer_id AS principal, object_id AS id, CASE arg_max(status, (received_at, version)) WHEN 'committed' THEN 2 ELSE 0 END AS l FROM sync_receipt GROUP BY 1, 2)
SELECT DISTINCT principal AS principal_id, id FROM (SELECT g.principal, h.id FROM g JOIN head h USING (workspace_id) WHERE l >= 2 UNION ALL SELECT og.principal, h.id FROM og JOIN head h ON h.id = og.id WHERE l >= 2)"""
)
def permitted_objects(spark, folder):
    """Objects that peers may write, by grants on workspaces and on single objects."""
    last = F.right("id", F.lit(1))
    wide = table(spark, folder, "sync_peer").select(F.col("id").alias("principal_id"), F.lit("workspace").alias("scope_kind"), F.col("workspace_id").alias("scope_id"), F.when(last.isin(*"0123"), "read").when(last.isin(*"4567"), "write").otherwise("admin").alias("level"), F.struct(F.col("created_at"), F.lit(0)).alias("at"))
    own = table(spark, folder, "sync_receipt").select(F.col("peer_id").alias("principal_id"), F.lit("object").alias("scope_kind"), F.col("object_id").alias("scope_id"), F.when(F.col("status") == "committed", "write").alias("level"), F.struct(F.col("received_at").alias("created_at"), F.col("version").alias("col2")).alias("at"))
    grants = wide.select("principal_id", "scope_kind", "scope_id", "level", F.col("at.created_at").alias("t"), F.lit(0).alias("n")).unionByName(own.select("principal_id", "scope_kind", "scope_id", "level", F.col("at.created_at").alias("t"), F.col("at.col2").alias("n")))
    return L.permitted(current_rows(ko(spark, folder), "workspace_id"), grants.withColumn("at", F.struct("t", "n")), "write")


@query(
    """SELECT id, last_contact + INTERVAL 30 DAY > TIMESTAMP '2026-01-01' OR last_contact IS NULL AS live, coalesce(NOT (last_contact + INTERVAL 30 DAY > TIMESTAMP '2026-01-01') AND last_contact + INTERVAL 30 DAY < TIMESTAMP '2025-12-02', false) AS prune FROM sync_peer"""
)
def live_peers(spark, folder):
    """Peers heard of within thirty days, and those to forget."""
    rows = table(spark, folder, "sync_peer").select("id", (F.col("last_contact") + F.expr("interval 30 days")).alias("expires_at"), F.lit(None).cast("timestamp_ntz").alias("revoked_at"))
    return L.live(rows, NOW).select("id", "live", "prune")


@query(f"WITH {HEAD}, c AS (SELECT workspace_id, count(*) AS objects FROM head GROUP BY 1), p AS (SELECT workspace_id, count(DISTINCT id) AS peers, max(last_contact) AS last_contact FROM sync_peer GROUP BY 1) SELECT c.workspace_id, objects, coalesce(peers, 0) AS peers, last_contact FROM c LEFT JOIN p USING (workspace_id)")
def workspace_overview(spark, folder):
    """Objects and peers of each workspace."""
    c = current_rows(ko(spark, folder), "workspace_id").groupBy("workspace_id").agg(F.count("*").alias("objects"))
    p = table(spark, folder, "sync_peer").groupBy("workspace_id").agg(F.countDistinct("id").alias("peers"), F.max("last_contact").alias("last_contact"))
    return c.join(p, "workspace_id", "left").select("workspace_id", "objects", F.coalesce("peers", F.lit(0)).alias("peers"), "last_contact")


# --- accounts ----------------------------------------------------------------------------------------------------------
def runs(spark, folder):
    return first_rows(table(spark, folder, "capability_run"), "id", "workspace_id", "capability", "provider", "model", "task", "status", "cost_micros", "latency_ms", "started_at")


_EDGE_OF_DAY = "TIMESTAMP '2025-11-20'"
_SPEND = f"{RUNS}, sp AS (SELECT workspace_id, CAST(coalesce(sum(cost_micros) FILTER (WHERE started_at >= {_EDGE_OF_DAY}), 0) AS BIGINT) AS today, CAST(coalesce(sum(cost_micros) FILTER (WHERE started_at >= TIMESTAMP '2025-11-01'), 0) AS BIGINT) AS month, CAST(coalesce(sum(cost_micros), 0) AS BIGINT) AS total FROM runs GROUP BY 1)"
_AT = "2025-11-20 15:00:00"


@query(
    f"""WITH {_SPEND}, m AS (SELECT *, CASE WHEN total = 0 THEN 'free' WHEN total < 10000 THEN printf('$%.4f', total / 1e6) ELSE printf('$%.2f', total / 1e6) END AS cost FROM sp) SELECT workspace_id, today, month, total, cost FROM m"""
)
def spend_windows(spark, folder):
    """What each workspace spent today, this month and ever, as seen on an afternoon in November."""
    return A.spend(runs(spark, folder), _AT).select("workspace_id", "today", "month", "total", A.money(F.col("total")).alias("cost"))


@query(
    f"""WITH {_SPEND} SELECT r.id, CASE WHEN coalesce(cost_micros, 0) = 0 THEN NULL WHEN cost_micros > 9000 THEN 'call' WHEN cost_micros > greatest(0, 20000 - today) THEN 'day' WHEN cost_micros > greatest(0, 60000 - month) THEN 'month' END AS refused FROM runs r LEFT JOIN sp USING (workspace_id)"""
)
def budget_check(spark, folder):
    """Whether each call could be made once more within budgets for a call, the day and the month."""
    r = runs(spark, folder)
    return A.check_budget(r, r, _AT, 9000, 20000, 60000).select("id", "refused")


@query(
    f"""WITH {RUNS}, p AS (SELECT workspace_id, sha256(concat_ws(chr(31), capability, coalesce(task, ''))) AS key, count(*) - 1 AS hits, max(started_at) AS at_ FROM runs WHERE status = 'ok' GROUP BY 1, 2)
SELECT workspace_id, count(*) AS entries, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (WHERE hits > 0) AS reused, floor(1000 * sum(hits) / (count(*) + sum(hits)) + 0.5) / 1000 AS hit_rate, count(*) FILTER (WHERE at_ >= TIMESTAMP '2025-12-02') AS live FROM p GROUP BY 1"""
)
def cache_stats(spark, folder):
    """What a cache of finished tasks would have saved in each workspace, and how many entries still hold."""
    puts = runs(spark, folder).filter("status = 'ok'").select("workspace_id", H.content_hash(F.col("capability"), F.col("task")).alias("key"), F.col("id").alias("value"), F.col("started_at").alias("at"))
    state = A.cache_state(puts, NOW)
    live = state.groupBy("workspace_id").agg(F.sum(F.coalesce(F.col("live").cast("int"), F.lit(0))).alias("live"))
    return A.cache_stats(state).join(live, "workspace_id")


@query("WITH c AS (SELECT label AS model, len(embedding) AS dims, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2) SELECT CAST(model AS VARCHAR) AS model, CAST(dims AS INTEGER) AS dims, n, (SELECT count(*) FROM c) > 1 AS mixed FROM c")
def model_census(spark, folder):
    return A.model_census(table(spark, folder, "embeddings"), F.col("label").cast("string"), "embedding")


@query(f"WITH {RUNS} SELECT id, capability, provider, status, started_at FROM runs WHERE status <> 'ok' OR latency_ms > 2000 ORDER BY started_at DESC, id DESC LIMIT 100")
def run_history(spark, folder):
    """The last hundred runs that failed or took over two seconds."""
    rows = runs(spark, folder).filter((F.col("status") != "ok") | (F.col("latency_ms") > 2000))
    return rows.select("id", "capability", "provider", "status", "started_at").orderBy(F.desc("started_at"), F.desc("id")).limit(100)


@query(f"WITH {RUNS}, d AS (SELECT DISTINCT ON (id) * FROM derivation ORDER BY id, ingested_at) SELECT d.id, d.target_id, d.method, r.provider, r.status, r.started_at FROM d LEFT JOIN runs r ON r.id = d.run_id")
def derivation_runs(spark, folder):
    """Each derivation with the run it came from, if that is known."""
    d = first_rows(table(spark, folder, "derivation"), "id", "target_id", "method", "run_id")
    r = runs(spark, folder).select(F.col("id").alias("run_id"), "provider", "status", "started_at")
    return d.join(r, "run_id", "left").select("id", "target_id", "method", "provider", "status", "started_at")


@query(
    f"""WITH {HEAD}, {EDGE}, c AS (SELECT DISTINCT ON (least(src_id, dst_id), greatest(src_id, dst_id)) id, src_id AS a_id, dst_id AS b_id, confidence FROM edge WHERE type = 'contradicts' AND state = 'active' AND src_id IS NOT NULL ORDER BY least(src_id, dst_id), greatest(src_id, dst_id), confidence DESC NULLS LAST, id)
SELECT c.id, a_id, b_id, a.title AS a_title, b.title AS b_title, c.confidence FROM c LEFT JOIN head a ON a.id = a_id LEFT JOIN head b ON b.id = b_id WHERE coalesce(a.state, '') <> 'deleted' AND coalesce(b.state, '') <> 'deleted'"""
)
def conflict_list(spark, folder):
    """Recorded disagreements with both sides, one for each pair; those with a deleted side are hidden."""
    from lorestack.operators import graph as G

    e = first_rows(table(spark, folder, "relation"), "id", "src_id", "dst_id", "type", "state", "confidence")
    e = G.active(e).filter("type = 'contradicts' and src_id is not null")
    best = F.min(F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "id", "src_id", "dst_id", "confidence")).alias("b")
    one = e.groupBy(F.least("src_id", "dst_id").alias("x"), F.greatest("src_id", "dst_id").alias("y")).agg(best).select("b.id", F.col("b.src_id").alias("a_id"), F.col("b.dst_id").alias("b_id"), "b.confidence")
    nodes = current_rows(ko(spark, folder), "title", "state")
    for side in "ab":
        one = one.join(nodes.select(F.col("id").alias(f"{side}_id"), F.col("title").alias(f"{side}_title"), F.col("state").alias(f"{side}_state")), f"{side}_id", "left")
    shown = (F.coalesce("a_state", F.lit("")) != "deleted") & (F.coalesce("b_state", F.lit("")) != "deleted")
    return one.filter(shown).select("id", "a_id", "b_id", "a_title", "b_title", "confidence")


# --- small kernels over whole tables --------------------------------------------------------------------------------------
@query(
    r"""WITH d AS (SELECT doc_id, text, date_diff('second', captured_at, TIMESTAMP '2026-01-01') / 86400e0 AS days FROM documents), t AS (SELECT *, left(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g'), ' '), 120) AS title FROM d),
w AS (SELECT *, len(regexp_extract_all(text, '\S+')) AS words FROM t)
SELECT doc_id, title, CAST(greatest(20, least(200, floor(words / 120 + 0.5))) AS INTEGER) AS budget, CASE WHEN days < 45 THEN CAST(CAST(floor(days + 0.5) AS BIGINT) AS VARCHAR) || ' days' WHEN days < 365 THEN CAST(CAST(floor(days / 30 + 0.5) AS BIGINT) AS VARCHAR) || ' months' WHEN days / 365 < 1.75 THEN 'about a year' ELSE CAST(CAST(floor(days / 365 + 0.5) AS BIGINT) AS VARCHAR) || ' years' END AS age,
 length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), '(?i)\bhttps?://\S+', ' ', 'g'), '%\w+%[\\/][^\s"'']*', ' ', 'g'), '\b[A-Za-z]:\\[^\s"'']*', ' ', 'g'), '\.{0,2}[\\/][\w.-]+(?:[\\/][\w.-]+)+', ' ', 'g')) AS prose_chars,
 trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS normal FROM w"""
)
def document_kernels(spark, folder):
    """Title line, claim budget, age in words, length without addresses and the title as a normal claim, of every document."""
    days = (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.col("captured_at").cast("timestamp"))) / 86400
    rows = table(spark, folder, "documents")
    words = F.regexp_count("text", F.lit(r"\S+"))
    budget = F.greatest(F.lit(20), F.least(F.lit(200), F.floor(words / 120 + 0.5))).cast("int")
    title = T.title_line(F.col("text"))
    return rows.select("doc_id", title.alias("title"), budget.alias("budget"), A.age(days).alias("age"), F.length(T.strip_addresses(F.col("text"))).cast("long").alias("prose_chars"), F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " ")).alias("normal"))


@query(
    r"""WITH d AS (SELECT event_id, CAST(event_id % 97 AS VARCHAR) || CASE event_id % 5 WHEN 0 THEN 's' WHEN 1 THEN 'm' WHEN 2 THEN 'h' WHEN 3 THEN '' ELSE 'x' END AS t FROM events) SELECT t AS given, CAST(CASE WHEN regexp_full_match(t, '\d+s') THEN 1000 WHEN regexp_full_match(t, '\d+h') THEN 3600000 WHEN regexp_full_match(t, '\d+m?') THEN 60000 END * CAST(regexp_extract(t, '\d+') AS BIGINT) AS BIGINT) AS ms, count(*) AS n FROM d GROUP BY 1, 2"""
)
def durations(spark, folder):
    """Durations in words as milliseconds."""
    suffix = F.element_at(F.array(*map(F.lit, ("s", "m", "h", "", "x"))), (F.col("event_id") % 5 + 1).cast("int"))
    d = table(spark, folder, "events").select(F.concat((F.col("event_id") % 97).cast("string"), suffix).alias("given"))
    return d.groupBy("given", T.duration_ms(F.col("given")).alias("ms")).agg(F.count("*").alias("n"))


@query(
    rf"""WITH {HEAD}, t AS (SELECT id, trim(title) AS t FROM head) SELECT id, regexp_replace(lower(t), '^the\s+', '') IN ({", ".join(f"'{x}'" for x in sorted(C.COUNTRIES | C.CITIES))})
 OR regexp_matches(t, '(?i)\b(street|road|avenue|lane|boulevard|highway|bridge|airport|station|harbour|harbor|port|park|square|plaza|valley|island|beach|bay|river|lake|mountain|county|province|district|city|town|village|campus)$') AS place FROM t"""
)
def known_places(spark, folder):
    """Whether the title of each object is a place's name."""
    return current_rows(ko(spark, folder), "title").select("id", C.known_place(F.col("title")).alias("place"))


@query()
def extracted_mentions(spark, folder):
    """Names found in objects, resolved to entities of their workspace or new ones."""
    rows = current_rows(ko(spark, folder), "workspace_id", "kind", "title", "body", "attrs", "state", "created_at")
    entities = rows.filter(kind_key() == "entity").select("id", "workspace_id", "title", F.from_json(F.get_json_object("attrs", "$.aliases"), "array<string>").alias("aliases"), F.lower(F.get_json_object("attrs", "$.entityType")).alias("entity_type"), "state", "created_at")
    texts = rows.filter(kind_key() != "entity").select("id", F.concat_ws("\n", "title", "body").alias("text"))
    found = C.extract_names(texts, "id", "text").join(rows.select(F.col("id").alias("key"), "workspace_id"), "key")
    return E.link_mentions(found.select(F.col("key").alias("object_id"), "workspace_id", "text", "type", "confidence"), entities)
