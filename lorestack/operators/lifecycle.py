"""Versioned records: creation, changes as a fold over patches, events, evidence, access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.operators.history import content_hash
from lorestack.session import lookup_join

# What records may hold.
ORIGINS = ("user", "source", "algorithm", "ai")
EPISTEMICS = ("fact", "observation", "belief", "hypothesis", "inference", "conclusion", "speculation")
WATCHED = ("title", "body", "attrs", "epistemic", "confidence", "review", "state", "superseded_by", "valid_until")
#: What a kind of change does to state and review.
STATE_OF = {"archive": "archived", "delete": "deleted", "restore": "active", "supersede": "superseded"}
REVIEW_OF = {"confirm": "confirmed", "reject": "rejected"}
LEVELS = {"read": 1, "write": 2, "admin": 3}


def _pick(of: Column, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), of)


def object_hash(kind: str = "kind", title: str = "title", body: str = "body", attrs: str = "attrs") -> Column:
    """The hash of what a record says: kind, trimmed title and body, attributes with their keys in order."""
    tidy = F.coalesce(F.to_json(F.try_parse_json(F.coalesce(attrs, F.lit("{}")))), F.lit("{}"))
    return content_hash(F.col(kind), F.trim(title), F.trim(F.coalesce(body, F.lit(""))), tidy)


def create(inputs: DataFrame, existing: DataFrame) -> DataFrame:
    """(input_id, outcome, id, epistemic, content_hash) of records to create (input_id, workspace_id, kind, title, body,
    attrs, epistemic, origin, confidence, at) beside existing heads (id, workspace_id, kind, title, body, attrs, origin,
    state, review, created_at).

    outcome is 'invalid' (no title, no workspace, unknown origin or epistemic, a confidence outside [0, 1]), 'existing'
    (a record of the workspace and origin says the same, is active or archived and not rejected: the oldest one) or
    'created'. Of equal inputs the first by (at, input_id) is created and the others find it. The epistemic of what a
    machine derived is inference unless given, else observation."""
    epistemic = F.coalesce("epistemic", F.when(F.col("origin").isin("ai", "algorithm"), "inference").otherwise("observation"))
    bad = (
        (F.coalesce(F.trim("title"), F.lit("")) == "") | F.col("workspace_id").isNull() | ~F.coalesce(F.col("origin").isin(*ORIGINS), F.lit(False))
        | ~epistemic.isin(*EPISTEMICS) | F.coalesce(~F.col("confidence").between(0, 1), F.lit(False))
    )
    rows = inputs.select("input_id", "workspace_id", "origin", "at", epistemic.alias("epistemic"), bad.alias("bad"), object_hash().alias("content_hash"))
    usable = existing.filter(F.col("state").isin("active", "archived") & ~F.coalesce(F.col("review") == "rejected", F.lit(False)))
    key = ["workspace_id", "origin", "content_hash"]
    # combined before the shuffle: one row for each content
    known = usable.select("workspace_id", "origin", object_hash().alias("content_hash"), "id", "created_at").groupBy(*key).agg(F.min(F.struct("created_at", "id")).alias("k"))
    first = rows.filter("not bad").groupBy(*key).agg(F.min(F.struct("at", "input_id")).alias("f"))
    out = rows.join(known.select(*key, F.col("k.id").alias("known")), key, "left").join(first.select(*key, F.col("f.input_id").alias("first")), key, "left")
    outcome = F.when(F.col("bad"), "invalid").when(F.col("known").isNotNull(), "existing").when(F.col("first") == F.col("input_id"), "created").otherwise("existing")
    found = F.when(~F.col("bad"), F.coalesce("known", F.concat(F.lit("new_"), F.col("first").cast("string"))))
    return out.select("input_id", outcome.alias("outcome"), found.alias("id"), F.when(~F.col("bad"), F.col("epistemic")).alias("epistemic"), "content_hash")


def apply_changes(heads: DataFrame, patches: DataFrame) -> DataFrame:
    """One row per patch: (id, patch_id, outcome, head_version, changed, and the WATCHED fields after it).

    patches: patch_id, id, at, change ('edit', 'confirm', 'reject', 'archive', 'delete', 'restore', 'supersede') and title,
    body, attrs, epistemic, confidence, superseded_by, null where the field stays. heads: id, head_version, WATCHED.
    Patches of a record are taken by (at, patch_id). outcome: 'missing' (no such record), 'invalid' (an empty title, an
    unknown epistemic, a confidence outside [0, 1], a record superseded by itself or by nothing), 'deleted' (the record
    was deleted and this doesn't restore it), 'unchanged' (no version is made) or 'changed' (head_version goes up by one).

    A fold written as windows over the patches of a record: whether it is deleted follows from the deletions and
    restorations before, each field from the last valid patch that sets it."""
    own = Window.partitionBy("id").orderBy("at", "patch_id")
    before, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    old = heads.select("id", F.col("head_version").alias("_v"), *[F.col(c).alias(f"_{c}") for c in WATCHED])
    rows = patches.join(old, "id", "left")
    change = F.col("change")
    bad = (
        ~change.isin("edit", *STATE_OF, *REVIEW_OF) | (F.trim("title") == "") | ~F.col("epistemic").isin(*EPISTEMICS) | ~F.col("confidence").between(0, 1)
        | (change == "supersede") & (F.col("superseded_by").isNull() | (F.col("superseded_by") == F.col("id")))
    )
    rows = rows.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    fate = F.when(~F.col("_bad") & change.isin("delete", "restore"), change == "delete")
    gone = F.coalesce(F.last(fate, ignorenulls=True).over(before), F.col("_state") == "deleted", F.lit(False))
    rows = rows.withColumn("_gone", gone)
    rows = rows.withColumn("_ok", F.col("_v").isNotNull() & ~F.col("_bad") & (~F.col("_gone") | (change == "restore")))
    ended = F.when(change == "supersede", F.col("at"))
    given = {c: F.col(c) for c in ("body", "attrs", "epistemic", "confidence")} | {
        "title": F.trim("title"), "review": _pick(change, REVIEW_OF), "state": _pick(change, STATE_OF), "superseded_by": F.when(change == "supersede", F.col("superseded_by")), "valid_until": ended,
    }
    after = {c: F.coalesce(F.last(F.when(F.col("_ok"), given[c]), ignorenulls=True).over(upto), F.col(f"_{c}")) for c in WATCHED}
    rows = rows.select("id", "patch_id", "at", "_v", "_bad", "_gone", "_ok", *[F.col(f"_{c}") for c in WATCHED], *[after[c].alias(f"n_{c}") for c in WATCHED])
    first = F.row_number().over(own) == 1
    was = {c: F.when(first, F.col(f"_{c}")).otherwise(F.lag(f"n_{c}").over(own)) for c in WATCHED}
    changed = F.array_compact(F.array(*[F.when(~F.col(f"n_{c}").eqNullSafe(was[c]), F.lit(c)) for c in WATCHED]))
    rows = rows.withColumn("changed", changed)
    step = F.when(F.col("_ok") & (F.size("changed") > 0), 1).otherwise(0)
    version = F.col("_v") + F.sum(step).over(upto)
    outcome = F.when(F.col("_v").isNull(), "missing").when(F.col("_bad"), "invalid").when(~F.col("_ok"), "deleted").when(step == 1, "changed").otherwise("unchanged")
    return rows.select("id", "patch_id", outcome.alias("outcome"), version.cast("int").alias("head_version"), "changed", *[F.col(f"n_{c}").alias(c) for c in WATCHED])


def version_events(versions: DataFrame) -> DataFrame:
    """(id, head_version, event): what each version (id, head_version, state, review, superseded_by) was the event of."""
    own = Window.partitionBy("id").orderBy("head_version")
    state, review = F.col("state"), F.col("review")
    moved = ~state.eqNullSafe(F.lag("state").over(own))
    judged = ~review.eqNullSafe(F.lag("review").over(own))
    event = (
        F.when(F.row_number().over(own) == 1, "captured")
        .when(moved & (state == "superseded"), "superseded").when(moved & (state == "archived"), "archived").when(moved & (state == "deleted"), "deleted").when(moved & (state == "active"), "restored")
        .when(judged & (review == "confirmed"), "confirmed").when(judged & (review == "rejected"), "rejected").otherwise("updated")
    )
    return versions.select("id", "head_version", event.alias("event"))


def link_evidence(rows: DataFrame) -> DataFrame:
    """rows (id, target_kind, target_id, source_id, object_id, stance, weight) with stance and weight filled in and `error`:
    'target' (no target or an unknown kind), 'ground' (neither a source nor an object), 'stance', 'weight' or null."""
    blank = lambda c: F.coalesce(F.trim(F.translate(c, "\t", " ")), F.lit("")) == ""
    stance, weight = F.coalesce("stance", F.lit("supports")), F.coalesce("weight", F.lit(1.0))
    error = (
        F.when(blank("target_id") | ~F.coalesce(F.col("target_kind").isin("object", "relation"), F.lit(False)), "target").when(blank("source_id") & blank("object_id"), "ground")
        .when(~stance.isin("supports", "contradicts", "mentions"), "stance").when((weight < 0) | (weight > 1), "weight")
    )
    return rows.withColumn("stance", stance).withColumn("weight", weight).withColumn("error", error)


def touch(objects: DataFrame, accesses: DataFrame) -> DataFrame:
    """(id, access_count, last_access) of objects (id, access_count, last_access) after accesses (id, at): counters are
    aggregates of the events, combined before the shuffle. Accesses of unknown objects are ignored."""
    new = accesses.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    joined = objects.select("id", "access_count", "last_access").join(new, "id", "left")
    return joined.select("id", (F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("access_count"), F.greatest("last_access", "_at").alias("last_access"))


def permitted(objects: DataFrame, grants: DataFrame, level: str = "read") -> DataFrame:
    """(principal_id, id): what each principal may do at least `level` with: objects (id, workspace_id) by the greatest of
    the grants (principal_id, scope_kind 'workspace' or 'object', scope_id, level) on the object and on its workspace.
    The latest grant (greatest `at`) of a principal and scope counts; a null level revokes."""
    rank = F.coalesce(_pick(F.col("level"), {k: str(v) for k, v in LEVELS.items()}).cast("int"), F.lit(0))
    latest = grants.groupBy("principal_id", "scope_kind", "scope_id").agg(F.max_by(rank, "at").alias("r")).filter(F.col("r") >= LEVELS[level])
    wide = latest.filter("scope_kind = 'workspace'").select("principal_id", F.col("scope_id").alias("workspace_id"))
    own = latest.filter("scope_kind = 'object'").select("principal_id", F.col("scope_id").alias("id"))
    through = lookup_join(objects.select("id", "workspace_id"), wide, ["workspace_id"], spread=F.col("id")).select("principal_id", "id")
    return through.unionByName(objects.select("id").join(own, "id").select("principal_id", "id")).distinct()


def live(rows: DataFrame, now: str, expires: str = "expires_at", revoked: str = "revoked_at", keep_days: int = 30) -> DataFrame:
    """rows with `live` (not revoked, and not expired at the instant) and `prune` (dead for more than keep_days)."""
    at = F.lit(now).cast("timestamp_ntz")
    ended = F.least(expires, revoked)
    alive = F.col(revoked).isNull() & (F.col(expires).isNull() | (F.col(expires) > at))
    return rows.withColumn("live", alive).withColumn("prune", F.coalesce(~alive & (ended < at - F.expr(f"interval {keep_days} days")), F.lit(False)))


def add_aliases(entities: DataFrame, new: DataFrame) -> DataFrame:
    """(id, aliases, changed): entities (id, title, aliases) after aliases (id, alias) were added: a set without the title,
    blanks and repeats; changed says whether a new version is due."""
    more = new.filter(F.trim("alias") != "").groupBy("id").agg(F.array_sort(F.collect_set(F.trim("alias"))).alias("_m"))
    none = F.array().cast("array<string>")
    old = F.coalesce("aliases", none)
    rows = entities.join(more, "id", "left").withColumn("_a", F.array_except(F.array_union(old, F.coalesce("_m", none)), F.array("title")))
    return rows.select("id", F.col("_a").alias("aliases"), (F.size(F.array_except("_a", old)) > 0).alias("changed"))
