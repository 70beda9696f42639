"""References to records that do not exist.

Method: the distinct non-null foreign keys are left-anti-joined against the usable parent keys; the few keys that
remain are joined back to the references, which are then listed or counted per table, field and period.

Scale: references are combined before each shuffle (deliveries of one record, then repeats of one key), so a key that
holds a third of all references is one row per map task in the anti-join. In the join back a hot key is spread over
`salts` tasks. Nothing is broadcast by hand and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestack.sources.tables import table


@dataclass(frozen=True)
class Reference:
    """`table.field` holds keys of `parent`; with `only_if`, just in rows where that column has that value."""

    table: str
    field: str
    parent: str
    only_if: tuple[str, str] | None = None


#: The references of the store.
REFERENCES = (
    Reference("relation", "dst_id", "knowledge_object"),
    Reference("derivation", "run_id", "capability_run"),
    Reference("evidence", "source_id", "source_item"),
    Reference("evidence", "target_id", "knowledge_object", ("target_kind", "object")),
    Reference("evidence", "target_id", "relation", ("target_kind", "relation")),
)


def tidy_key(key: Column) -> Column:
    """Keys compare without case and surrounding blanks and tabs; a blank key is null."""
    tidy = F.lower(F.regexp_replace(key, r"^[ \t]+|[ \t]+$", ""))
    return F.when(tidy != "", tidy)


def parent_keys(name: str, parent: DataFrame) -> DataFrame:
    """(parent, key, landed, deleted) of a referred table, one row per key."""
    key = tidy_key(F.col("id")).alias("key")
    if "state" in parent.columns and "head_version" in parent.columns and name == "knowledge_object":
        head = F.min(F.struct((-F.col("head_version")).alias("v"), F.col("ingested_at").alias("at"), (F.col("state").eqNullSafe("deleted")).alias("deleted")))
        rows = parent.select(key, "head_version", "ingested_at", "state").groupBy("key").agg(F.min("ingested_at").alias("landed"), head.alias("h"))
        rows = rows.select("key", "landed", F.col("h.deleted").alias("deleted"))
    else:
        rows = parent.select(key, "ingested_at").groupBy("key").agg(F.min("ingested_at").alias("landed")).withColumn("deleted", F.lit(False))
    return rows.filter("key is not null").select(F.lit(name).alias("parent"), "key", "landed", "deleted")


def reference_rows(children: Mapping[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """(table_name, field_name, parent, key, record_id, created_at, landed), one row per record and non-blank key."""
    parts = []
    for name in dict.fromkeys(r.table for r in references):
        own = [r for r in references if r.table == name]
        fields = list(dict.fromkeys([r.field for r in own] + [r.only_if[0] for r in own if r.only_if]))
        records = children[name].groupBy("id", *fields, "created_at").agg(F.min("ingested_at").alias("landed"))
        keys = []
        for r in own:
            key = tidy_key(F.col(r.field))
            if r.only_if:
                key = F.when(F.lower(F.trim(F.col(r.only_if[0]))) == r.only_if[1], key)
            keys.append(F.struct(F.lit(r.field).alias("field_name"), F.lit(r.parent).alias("parent"), key.alias("key")))
        unpivoted = records.select("id", "created_at", "landed", F.explode(F.array(*keys)).alias("r"))
        parts.append(unpivoted.filter("r.key is not null").select(F.lit(name).alias("table_name"), "r.*", F.col("id").alias("record_id"), "created_at", "landed"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def find_orphans(children: Mapping[str, DataFrame], parents: Mapping[str, DataFrame], references: Sequence[Reference] = REFERENCES, salts: int = 8) -> DataFrame:
    """One row per orphan reference: table_name, field_name, record_id, key, created_at, reason.

    reason is 'missing' (no record has the key), 'deleted' (the current row of the object is deleted) or 'late' (the
    record landed after the referring one). Null, empty and blank keys are no references. A record that landed several
    times counts once, at its first landing. Values of `only_if` columns that name no reference are ignored. Unknown
    landings (null) count as present. Empty tables give an empty result, or all references as missing. Only the named
    columns are read, so further columns of any name do no harm.
    """
    refs = reference_rows(children, references)
    known = None
    for name in dict.fromkeys(r.parent for r in references):
        keys = parent_keys(name, parents[name])
        known = keys if known is None else known.unionByName(keys)
    distinct = refs.groupBy("parent", "key").agg(F.min("landed").alias("first_ref"))
    usable = known.filter(~F.col("deleted")).select(F.col("parent").alias("p"), F.col("key").alias("k"), F.col("landed").alias("there"))
    in_time = F.col("there").isNull() | F.col("first_ref").isNull() | (F.col("there") <= F.col("first_ref"))
    doubtful = distinct.join(usable, (F.col("parent") == F.col("p")) & (F.col("key") == F.col("k")) & in_time, "left_anti")
    reasons = doubtful.join(known, ["parent", "key"], "left").select("parent", "key", F.col("landed").alias("there"), "deleted")
    spread = refs.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
    repeated = reasons.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    reason = F.when(F.col("deleted").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("there") > F.col("landed"), "late")
    found = spread.join(repeated, ["parent", "key", "salt"]).withColumn("reason", reason)
    return found.filter("reason is not null").select("table_name", "field_name", "record_id", "key", "created_at", "reason")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field and month of created_at, by reason; a null created_at gives a null month."""
    month = F.date_format("created_at", "yyyy-MM").alias("month")
    count = lambda reason: F.sum(F.when(F.col("reason") == reason, 1).otherwise(0)).alias(reason)
    return orphans.groupBy("table_name", "field_name", month).agg(F.count("*").alias("orphans"), count("missing"), count("deleted"), count("late"))


def _store_orphans(spark: SparkSession, folder: str) -> DataFrame:
    tables = {n: table(spark, folder, n) for n in ("relation", "derivation", "evidence", "knowledge_object", "capability_run", "source_item")}
    return find_orphans(tables, tables)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _store_orphans(spark, folder).select("table_name", "field_name", "record_id")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_store_orphans(spark, folder))


_SQL = """
WITH ko AS (
  SELECT k, min(ingested_at) AS landed, arg_min(deleted, (-head_version, ingested_at)) AS deleted
  FROM (SELECT lower(trim(id, ' ' || chr(9))) AS k, ingested_at, head_version, coalesce(state = 'deleted', false) AS deleted FROM knowledge_object) GROUP BY k),
par AS (
  SELECT 'knowledge_object' AS parent, k, landed, deleted FROM ko
  UNION ALL SELECT 'relation', lower(trim(id, ' ' || chr(9))), min(ingested_at), false FROM relation GROUP BY 2
  UNION ALL SELECT 'capability_run', lower(trim(id, ' ' || chr(9))), min(ingested_at), false FROM capability_run GROUP BY 2
  UNION ALL SELECT 'source_item', lower(trim(id, ' ' || chr(9))), min(ingested_at), false FROM source_item GROUP BY 2),
child AS (
  SELECT 'relation' AS table_name, 'dst_id' AS field_name, 'knowledge_object' AS parent, id, dst_id AS k, created_at, ingested_at FROM relation
  UNION ALL SELECT 'derivation', 'run_id', 'capability_run', id, run_id, created_at, ingested_at FROM derivation
  UNION ALL SELECT 'evidence', 'source_id', 'source_item', id, source_id, created_at, ingested_at FROM evidence
  UNION ALL SELECT 'evidence', 'target_id', CASE lower(trim(target_kind)) WHEN 'object' THEN 'knowledge_object' WHEN 'relation' THEN 'relation' END, id, target_id, created_at, ingested_at FROM evidence),
refs AS (
  SELECT table_name, field_name, parent, id AS record_id, lower(trim(k, ' ' || chr(9))) AS k, created_at, min(ingested_at) AS landed
  FROM child WHERE parent IS NOT NULL AND trim(k, ' ' || chr(9)) <> '' GROUP BY ALL),
orph AS (
  SELECT r.*, CASE WHEN p.k IS NULL THEN 'missing' WHEN p.deleted THEN 'deleted' WHEN p.landed > r.landed THEN 'late' END AS reason
  FROM refs r LEFT JOIN par p ON p.parent = r.parent AND p.k = r.k)
"""
SQL = {
    "p1_found": _SQL + "SELECT table_name, field_name, record_id FROM orph WHERE reason IS NOT NULL",
    "p1_report": _SQL
    + """SELECT table_name, field_name, strftime(created_at, '%Y-%m') AS month, count(*) AS orphans,
 CAST(sum(CASE WHEN reason = 'missing' THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN reason = 'deleted' THEN 1 ELSE 0 END) AS BIGINT) AS deleted,
 CAST(sum(CASE WHEN reason = 'late' THEN 1 ELSE 0 END) AS BIGINT) AS late FROM orph WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
}
QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
