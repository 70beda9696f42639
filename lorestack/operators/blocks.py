"""Pairs of records that share a block, without one task holding a block.

Blocks of up to `cell` members are joined as they are. Larger ones are laid out as a square of cells: members are spread
over n parts by a hash, and part i meets part j in a cell of its own, so the pairs of a hot block are made by n * n tasks
of bounded size. No pair is lost and none is capped.

Block sizes come with the one shuffle by block. Blocks that are hot (some HOT members and more) are told beforehand by
a count over one row in SAMPLE, and their members go through that shuffle in salted parts. The sample only steers where
rows travel: a block that it misses is counted like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorestack.session import cut, lookup_join

#: Members from which a block is hot, and how many rows stand behind each that is counted to find out.
HOT, SAMPLE = 8192, 64


def hot_blocks(rows: DataFrame, block: Sequence[str], member: str, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """(block columns, _est): the hot blocks and about how many members each has; at most rows / hot, give or take.

    Written once, so that every later read and every task that runs again sees the same blocks."""
    some = rows.filter(F.pmod(F.xxhash64(*block, member), F.lit(sample)) == 0)
    return cut(some.groupBy(*block).agg((F.count("*") * sample).alias("_est")).filter(F.col("_est") >= hot))


def block_pairs(members: DataFrame, block: Sequence[str], member: str, carry: Sequence[str] = (), cell: int = 512, hot: int = HOT, sample: int = SAMPLE, pairs_per_block: bool = False) -> DataFrame:
    """(a, b, then carry columns as <name>_a and <name>_b): pairs a < b of different members of any common block.

    Each pair comes once, however many blocks it shares; with `pairs_per_block` once for each of them. Rows with a null block column or member give no pairs; a member
    repeated in a block counts once in the result. Singletons are dropped right after the one shuffle by block, and
    what is left is written once and read by both sides. `members` is read twice: what is dear to make should be cut.
    """
    names = [f"_b{i}" for i in range(len(block))]  # block columns may have any name
    rows = members.select(*[F.col(c).alias(n) for c, n in zip(block, names)], F.col(member).alias("_m"), *carry)
    block = names
    rows = rows.filter(" and ".join(f"`{c}` is not null" for c in [*block, "_m"]))
    spread = lookup_join(rows, hot_blocks(rows, block, "_m", hot, sample), block, "left", spread=F.col("_m"))
    salt = F.coalesce(F.pmod(F.xxhash64("_m"), F.ceil(F.col("_est") / hot)), F.lit(0)).cast("int")
    # repeats are dropped once the singletons are gone; they can only make _n too large, which means more cells
    counted = spread.withColumn("_salt", salt).withColumn("_n", F.coalesce("_est", F.count("*").over(Window.partitionBy(*block, "_salt"))))
    counted = cut(counted.filter("_n > 1").dropDuplicates([*block, "_salt", "_m"]).drop("_salt", "_est"))
    parts = F.ceil(F.col("_n") / cell).cast("int")
    laid = counted.withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64("_m"), F.col("_parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left = laid.withColumn("_j", every).select(*block, F.col("_own").alias("_i"), "_j", F.col("_m").alias("a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    right = laid.withColumn("_i", every).select(*block, "_i", F.col("_own").alias("_j"), F.col("_m").alias("b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    pairs = left.join(right, [*block, "_i", "_j"]).filter("a < b")
    pairs = pairs.select("a", "b", *[f"{c}_a" for c in carry], *[f"{c}_b" for c in carry])
    return pairs if pairs_per_block else pairs.dropDuplicates(["a", "b"])
