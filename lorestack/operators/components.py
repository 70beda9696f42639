"""Connected components of a graph of any size, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestack.session import cut, lookup_join


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m): the lowest of u and its neighbours; combined before the shuffle, so a hub is one row per map task."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(node, component): component is the lowest node of the component; nodes are those that occur in an edge.

    Self loops, repeated edges and both directions are allowed; edges with a null end are ignored; no edges give no
    rows. Each round halves the depth of the trees at least; the lineage is cut after each half of a round by a
    written table, as the next half reads it three times.
    Hubs are spread by a hash of the neighbour when the lowest neighbours are joined back.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    nodes = pairs.select("u").union(pairs.select("v")).distinct()
    state = cut(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(lookup_join(both.filter("v > u"), _lowest(both), ["u"], spread=F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = _lowest(large)
        small = lookup_join(large, low, ["u"], spread=F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # large-star of the next round starts from (node, lowest) and (lower neighbour, lowest)
        state = cut(small.union(low.select("u", F.col("m").alias("v")).filter("u <> v")).distinct())
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    return nodes.join(state.groupBy("u").agg(F.min("v").alias("m")), "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))
