"""Structured Streaming: ingestion, incremental statistics, debouncing. The transformations also run on batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorestack.functions import text as T
from lorestack.operators.incremental import VersionedTarget


def watch_files(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """New files below a folder as a stream: (path, length, modificationTime, content), each state of a file once."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["path", "length", "modificationTime"])


def watch_table(spark: SparkSession, path: str, schema: str, stamp: str | None = None, late: str = "1 day") -> DataFrame:
    """Parquet files as they are added to a folder; with `stamp`, watermarked on it."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withWatermark(stamp, late) if stamp else rows


def debounce(events: DataFrame, key: str, stamp: str, gap: str) -> DataFrame:
    """(key, first_ts, last_ts, n): events of a key that follow each other within a gap count as one.

    On a stream the caller sets a watermark on `stamp`; a burst comes out once it can't grow any more."""
    w = events.groupBy(F.session_window(stamp, gap).alias("w"), key).agg(F.count("*").alias("n"), F.min(stamp).alias("first_ts"), F.max(stamp).alias("last_ts"))
    return w.select(key, "first_ts", "last_ts", "n")


def windowed_counts(events: DataFrame, key: str, stamp: str, width: str) -> DataFrame:
    """(window, key, n, total) per tumbling window."""
    return events.groupBy(F.window(stamp, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def term_deltas(changes: DataFrame) -> DataFrame:
    """(term, df): document frequencies kept up to date from changes (text, delta = 1 for added, -1 for removed)."""
    terms = changes.select("delta", F.explode(F.array_distinct(T.content_terms(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.sum("delta").alias("df"))


def drain(stream: DataFrame, target: VersionedTarget, keys: list[str], version: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs each micro-batch into a versioned target. A batch that is repeated after a failure finds its rows already in
    the target and publishes nothing, so records are neither skipped nor repeated."""

    def one(batch: DataFrame, _: int) -> None:
        target.run(batch, keys, version, work)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def stop_gracefully(query: StreamingQuery) -> None:
    """Ends a stream once what has arrived is worked on."""
    query.processAllAvailable()
    query.stop()
