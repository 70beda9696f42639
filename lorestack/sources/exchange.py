"""Export and import of workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of an export in the order in which an import loads them, with the references that must hold.
TABLES = {
    "knowledge_object": (),
    "source_item": (),
    "relation": (("src_id", "knowledge_object"), ("dst_id", "knowledge_object")),
    "evidence": (("source_id", "source_item"),),
    "derivation": (),
    "capability_run": (),
    "sync_peer": (),
}


def fingerprint(df: DataFrame) -> str:
    """A checksum of a table's rows, whatever their order and partitions: counts and sums of row hashes."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    r = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return f"{r[0]}-{r[1]}-{r[2]}"


def export_workspace(tables: dict[str, DataFrame], workspace: str, path: str) -> dict[str, str]:
    """Writes the rows of a workspace, a folder per table, and returns the checksum of each."""
    out = {}
    for name in TABLES:
        if name in tables:
            rows = tables[name].filter(F.col("workspace_id") == workspace)
            rows.write.mode("errorifexists").parquet(f"{path}/{name}")
            out[name] = fingerprint(rows.sparkSession.read.parquet(f"{path}/{name}"))
    return out


def plan_import(spark: SparkSession, path: str, existing: dict[str, DataFrame], checksums: dict[str, str] | None = None, on_existing: str = "skip") -> dict[str, DataFrame]:
    """The rows to add, by table: ids that exist are skipped (or refused, with on_existing = 'fail'), rows whose references
    neither the import nor the store has are dropped, and only columns that the store's table has are taken. A table whose
    checksum differs is refused. Nothing is written: a dry run is the plan itself; import_warnings tells what it leaves out."""
    incoming, out = {}, {}
    for name, references in TABLES.items():
        try:
            rows = spark.read.parquet(f"{path}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        if checksums and checksums.get(name) != fingerprint(rows):
            raise ValueError(f"the checksum of {name} differs")
        incoming[name] = rows
        if name in existing:
            allowed = set(existing[name].columns)
            rows = rows.select(*[c for c in rows.columns if c in allowed or len(allowed) == 1])
            if on_existing == "fail" and not rows.join(existing[name].select("id"), "id", "left_semi").isEmpty():
                raise ValueError(f"{name} has rows that are there already")
        kept = rows
        for column, parent in references:
            known = incoming[parent].select("id").union(existing[parent].select("id")) if parent in existing else incoming[parent].select("id")
            ok = kept.join(known.select(F.col("id").alias(column)).distinct(), column, "left_semi").select(*rows.columns)
            kept = ok.unionByName(kept.filter(F.col(column).isNull()))
        out[name] = kept.join(existing[name].select("id"), "id", "left_anti") if name in existing else kept
    return out


def import_warnings(spark: SparkSession, path: str, plan: dict[str, DataFrame], existing: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows, added, there, dropped) of an import: `there` are skipped ids, `dropped` rows with dangling references."""
    out = []
    for name, kept in plan.items():
        rows = spark.read.parquet(f"{path}/{name}")
        n, added = rows.count(), kept.count()
        there = rows.join(existing[name].select("id").distinct(), "id", "left_semi").count() if name in existing else 0
        out.append((name, n, added, there, n - added - there))
    return spark.createDataFrame(out, "table_name string, rows long, added long, there long, dropped long")  # one row a table
