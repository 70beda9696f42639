"""Parquet tables of a store and the views that the domain defines over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kind_key(kind: str = "kind") -> Column:
    """Kinds are typed by hand: compared without case and surrounding blanks."""
    return F.lower(F.trim(F.col(kind)))


def current_rows(objects: DataFrame, *columns: str) -> DataFrame:
    """The current row of each object: greatest head_version, earliest landing of it.

    One sort-free pass: the wanted columns travel in a struct that is ordered by (-head_version, ingested_at), so rows
    are combined before the shuffle. Exact repeats of the winning row collapse. Rows without an id are ignored.
    """
    picked = [F.col(c) for c in columns if c not in ("id", "head_version", "ingested_at")]
    best = F.min(F.struct((-F.col("head_version")).alias("_v"), F.col("ingested_at"), *picked)).alias("_r")
    grouped = objects.filter(F.col("id").isNotNull()).groupBy("id").agg(best)
    out = [F.col("id")]
    for c in columns:
        if c == "head_version":
            out.append((-F.col("_r._v")).cast("int").alias("head_version"))
        elif c != "id":
            out.append(F.col(f"_r.{c}").alias(c))
    return grouped.select(*out)


def current_wide(objects: DataFrame, *columns: str, where: Column | None = None) -> DataFrame:
    """Like current_rows for wide columns: the winner is found on narrow columns, and only rows that pass `where`
    carry their wide columns through the join. `where` is evaluated on the current row."""
    narrow = objects.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct((-F.col("head_version")).alias("_v"), F.col("ingested_at").alias("_at"))).alias("_r"))
    narrow = narrow.select("id", F.col("_r._v").alias("_v"), F.col("_r._at").alias("_at"))
    wide = objects.filter(F.col("id").isNotNull())
    if where is not None:
        wide = wide.filter(where)
    wide = wide.select("id", (-F.col("head_version")).alias("_wv"), F.col("ingested_at").alias("_wat"), *[F.col(c) for c in columns if c != "id"])
    joined = wide.join(narrow, "id").filter((F.col("_wv") == F.col("_v")) & F.col("_wat").eqNullSafe(F.col("_at")))
    return joined.drop("_v", "_at", "_wv", "_wat").dropDuplicates(["id"])
