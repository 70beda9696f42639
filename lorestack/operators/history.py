"""Versioned records: heads, history as of an instant, changes, decisions between replicas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(objects: DataFrame, *columns: str) -> DataFrame:
    """(id, head_version, ingested_at, columns): each version at its first landing."""
    own = Window.partitionBy("id", "head_version").orderBy("ingested_at")
    return objects.withColumn("_n", F.row_number().over(own)).filter("_n = 1").select("id", "head_version", "ingested_at", *columns)


def as_of(objects: DataFrame, instant: str, *columns: str) -> DataFrame:
    """The state of each object at an instant: the greatest version that had landed by then."""
    landed = objects.filter(F.col("ingested_at") <= F.lit(instant).cast("timestamp_ntz"))
    best = F.min(F.struct((-F.col("head_version")).alias("v"), F.col("ingested_at"), *columns)).alias("r")
    return landed.groupBy("id").agg(best).select("id", (-F.col("r.v")).alias("head_version"), *[F.col(f"r.{c}").alias(c) for c in columns])


def changes(objects: DataFrame, watched: Sequence[str]) -> DataFrame:
    """(id, head_version, changed): the watched fields in which a version differs from the one before, null-safe."""
    own = Window.partitionBy("id").orderBy("head_version")
    rows = versions(objects, *watched)
    differs = [F.when(~F.col(c).eqNullSafe(F.lag(c).over(own)), F.lit(c)) for c in watched]
    rows = rows.withColumn("_first", F.row_number().over(own) == 1).withColumn("changed", F.array_join(F.array_compact(F.array(*differs)), ","))
    return rows.filter(~F.col("_first")).select("id", "head_version", "changed")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by a unit separator."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def duplicates(rows: DataFrame, parts: Sequence[Column], within: Sequence[str], key: str, first: str) -> DataFrame:
    """(key, kept): rows of equal content within a group that an older row (by `first`, then key) stands for."""
    hashed = rows.select(*within, key, first, content_hash(*parts).alias("_h"))
    # combined before the shuffle: the kept row of each content is a minimum
    kept = hashed.groupBy(*within, "_h").agg(F.min(F.struct(first, key)).alias("_k"), F.count("*").alias("_n")).filter("_n > 1")
    return hashed.join(kept, [*within, "_h"]).filter(F.col(key) != F.col(f"_k.{key}")).select(key, F.col(f"_k.{key}").alias("kept"))


def sync_decisions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(id, decision) for objects (id, head_version, hash) of two replicas; nothing is ever deleted.

    insert: unknown here; skip: the same; take: the remote is ahead; keep: it is behind or unknown there; conflict: the
    same version with other content.
    """
    l, r = (df.select("id", F.col("head_version").alias(f"{s}v"), F.col("hash").alias(f"{s}h")) for s, df in (("l", local), ("r", remote)))  # noqa: E741
    decision = (
        F.when(F.col("lv").isNull(), "insert")
        .when(F.col("rv").isNull(), "keep")
        .when(F.col("rv") > F.col("lv"), "take")
        .when(F.col("rv") < F.col("lv"), "keep")
        .when(F.col("lh").eqNullSafe(F.col("rh")), "skip")
        .otherwise("conflict")
    )
    return l.join(r, "id", "full_outer").select("id", decision.alias("decision"))


def after(rows: DataFrame, cursor: tuple[str, str | None]) -> DataFrame:
    """Rows past a cursor (instant, id); without an id, past the whole instant."""
    at, last = F.lit(str(cursor[0])).cast("timestamp_ntz"), cursor[1]
    past = F.col("ingested_at") > at
    return rows.filter(past if last is None else past | (F.col("ingested_at") == at) & (F.col("id") > last))


def change_feed(streams: dict[str, DataFrame], cursors: dict[str, tuple[str, str | None]], limit: int) -> DataFrame:
    """(stream, id, ingested_at) of rows after each stream's cursor, at most `limit` a stream, by (ingested_at, id).

    A cursor is a pair (instant, id), so ties at a page's end are not skipped; feed_state gives the next ones.
    """
    out = None
    for name, df in streams.items():
        rows = after(df, cursors[name]).select("id", "ingested_at").orderBy("ingested_at", "id").limit(limit)
        rows = rows.select(F.lit(name).alias("stream"), "id", "ingested_at")
        out = rows if out is None else out.unionByName(rows)
    return out


def feed_state(streams: dict[str, DataFrame], cursors: dict[str, tuple[str, str | None]], page: DataFrame) -> dict[str, tuple[tuple[str, str | None], bool]]:
    """Stream -> (its cursor after a page of change_feed, complete: nothing is left after it)."""
    last = {r.stream: (str(r.m.ingested_at), r.m.id) for r in page.groupBy("stream").agg(F.max(F.struct("ingested_at", "id")).alias("m")).collect()}
    cursors = {name: last.get(name, cursors[name]) for name in streams}
    return {name: (cursors[name], after(df, cursors[name]).isEmpty()) for name, df in streams.items()}


def without_echo(outgoing: DataFrame, told: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outgoing rows without those that the peer itself has told of, compared on all `keys` (peer, id, version, and the
    content's hash where both sides have it)."""
    return outgoing.join(told.select(*keys).distinct(), list(keys), "left_anti")


def safe_cursor(state: dict[str, tuple[tuple[str, str | None], bool]]) -> str | None:
    """The instant up to which every stream is complete: the least of the last instants of those that were cut short;
    None where all are complete."""
    cut_short = [cursor[0] for cursor, complete in state.values() if not complete]
    return min(cut_short) if cut_short else None
