"""Session helpers: the shared folder, lineage cuts, and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this estimated size.
BROADCAST_BYTES = 16 * 1024 * 1024


def build_session(app: str = "lorestack", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the checkpoint folder set on the context.

    Only a session whose executors are threads of this machine (local mode) may do without: it gets a folder of its own.
    On a cluster a missing setting is an error, as each executor would write to its own disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lorestack-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df: it is computed once and read back from the shared folder.

    Written as a table rather than an RDD checkpoint, so that later reads keep columnar pruning and statistics,
    and lost executors only cost the tasks that were running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lorestack/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_small(df: DataFrame) -> DataFrame:
    """A small input (a file of one row group is one task) spread over all cores; a larger one stays where it is read."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if estimated_bytes(df) <= 4 * BROADCAST_BYTES else df


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", spread: Column | None = None, salts: int = 8, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Joins a large left side, whose keys may be skewed, with a right side.

    The right side is broadcast when its estimated size is below `limit`. Beyond it, rows of the left side are spread
    over `salts` parts of each key by a hash of `spread`, and the right side is repeated once for each part, so that a
    key that holds a third of the left side is worked on by `salts` tasks.
    """
    if estimated_bytes(right) <= limit:
        return left.join(F.broadcast(right), on, how)
    if spread is None:
        return left.join(right, on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
