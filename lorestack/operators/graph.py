"""The typed graph of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.session import cut, lookup_join

#: What a relation is called from its other end, and how far an origin is trusted.
INVERSE = {
    "causes": "caused_by", "caused_by": "causes", "part_of": "contains", "contains": "part_of", "precedes": "follows", "follows": "precedes",
    "supersedes": "superseded_by", "superseded_by": "supersedes", "derived_from": "derives", "derives": "derived_from",
}
SYMMETRIC = ("related_to", "similar_to", "contradicts")
AUTHORITY = {"user": 3, "source": 2}


def edges(relations: DataFrame) -> DataFrame:
    """Each relation once (its first delivery), with its ends set."""
    own = Window.partitionBy("id").orderBy("ingested_at")
    return relations.withColumn("_n", F.row_number().over(own)).filter("_n = 1 and src_id is not null and dst_id is not null").drop("_n")


def active(rel: DataFrame) -> DataFrame:
    return rel.filter(F.col("state") == "active")


def other_label(kind: Column) -> Column:
    pairs = [F.lit(x) for pair in INVERSE.items() for x in pair]
    return F.when(kind.isin(*SYMMETRIC), kind).otherwise(F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.concat(kind, F.lit(" (inbound)"))))


def neighbours(rel: DataFrame, of: DataFrame, nodes: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """(id, other, type, label, direction, confidence) of edges at the nodes `of` (id), seen from them.

    With `nodes` (id, state), edges whose other end is unknown or deleted are left out. An edge without a confidence
    passes any `least`."""
    if least > 0:
        rel = rel.filter(F.col("confidence").isNull() | (F.col("confidence") >= least))
    end = lambda a: of.select(F.col("id").alias(a))
    shape = lambda a, b, label, way: [F.col(a).alias("id"), F.col(b).alias("other"), "type", label.alias("label"), F.lit(way).alias("direction"), "confidence"]
    out = rel.join(end("src_id"), "src_id", "left_semi").select(*shape("src_id", "dst_id", F.col("type"), "out"))
    both = out.unionByName(rel.join(end("dst_id"), "dst_id", "left_semi").select(*shape("dst_id", "src_id", other_label(F.col("type")), "in")))
    return both if nodes is None else both.join(nodes.filter("state <> 'deleted'").select(F.col("id").alias("other")), "other", "left_semi").select(*both.columns)


def degrees(rel: DataFrame) -> DataFrame:
    """(id, degree): edges at either end; a self edge counts twice. Combined before the shuffle, so hubs are cheap."""
    return rel.select(F.explode(F.array("src_id", "dst_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def reach(rel: DataFrame, start: DataFrame, depth: int = 2, limit: int | None = None) -> DataFrame:
    """(id, depth, via, path): nodes within `depth` steps of the nodes `start` (id), in either direction, at their least depth.

    path holds the nodes from a start to the node, via the labels of the steps; of several first reaches that of the lowest
    (path, label) counts. With `limit` only the first `limit` nodes by (depth, id) are kept at each step. Each step joins
    the frontier with the edges and drops what was visited; the frontier is written to cut the lineage.
    """
    ways = rel.select(F.col("src_id").alias("id"), F.col("dst_id").alias("to"), F.col("type").alias("label")).unionByName(rel.select(F.col("dst_id").alias("id"), F.col("src_id").alias("to"), other_label(F.col("type")).alias("label")))
    seen = cut(start.select("id").distinct().select("id", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("via"), F.array("id").alias("path")))
    frontier, room = seen, limit
    for step in range(1, depth + 1):
        found = lookup_join(ways, frontier.select("id", "via", "path"), ["id"], spread=F.col("to"))
        new = found.groupBy("to").agg(F.min(F.struct(F.col("path").alias("p"), F.col("label").alias("l"), F.col("via").alias("v"))).alias("b"))
        new = new.select(F.col("to").alias("id"), F.lit(step).alias("depth"), F.concat("b.v", F.array("b.l")).alias("via"), F.concat("b.p", F.array("to")).alias("path"))
        frontier = new.join(seen.select("id"), "id", "left_anti").select("id", "depth", "via", "path")
        frontier = cut(frontier if room is None else frontier.orderBy("id").limit(max(0, room)))
        if room is not None:
            room -= frontier.count()
        seen = seen.unionByName(frontier)
    return seen


def trust(origin: str = "origin") -> Column:
    pairs = [F.lit(x) for pair in AUTHORITY.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(origin)), F.lit(1))


def settle(candidates: DataFrame) -> DataFrame:
    """One active edge for each (src_id, type, dst_id): that of the most trusted origin, then the latest; how often it was
    asserted is `asserted`. Self edges are dropped."""
    best = F.max(F.struct(trust().alias("t"), F.col("updated_at"), F.col("id"), F.col("origin"), F.col("confidence"))).alias("b")
    return candidates.filter("src_id <> dst_id").groupBy("src_id", "type", "dst_id").agg(best, F.count("*").alias("asserted")).select("src_id", "type", "dst_id", "b.id", "b.origin", "b.confidence", "asserted")


def assert_edges(rel: DataFrame, incoming: DataFrame) -> DataFrame:
    """(src_id, type, dst_id, id, outcome, head_version, origin, confidence) of asserted edges (id, src_id, type, dst_id,
    origin, confidence, at) against the active ones of `rel`.

    outcome is 'invalid' (a self edge, no type or no end), 'created' (no active edge of that triple, or the first of
    several new ones), 'blocked' (the edge that is there has more authority) or 'reinforced' (a new version of the edge
    that is there, with the greater confidence). Assertions of one triple are taken in order of (at, id); the authority an
    edge has grown to counts."""
    key = ["src_id", "type", "dst_id"]
    there = active(rel).groupBy(*key).agg(F.max(F.struct(trust().alias("t"), F.col("id").alias("eid"), F.col("head_version").alias("v"), F.col("confidence").alias("c"))).alias("e"))
    bad = F.col("src_id").isNull() | F.col("dst_id").isNull() | (F.col("src_id") == F.col("dst_id")) | (F.trim(F.coalesce("type", F.lit(""))) == "")
    rows = incoming.withColumn("_bad", bad).withColumn("_t", trust()).join(there, key, "left")
    own = Window.partitionBy(*key).orderBy("at", "id")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    held = F.greatest(F.col("e.t"), F.max(F.when(~F.col("_bad"), F.col("_t"))).over(before))
    outcome = F.when(F.col("_bad"), "invalid").when(held.isNull(), "created").when(F.col("_t") < held, "blocked").otherwise("reinforced")
    rows = rows.withColumn("outcome", outcome)
    taken = F.sum(F.when(F.col("outcome").isin("created", "reinforced"), 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(F.when(F.col("outcome") == "created", F.col("id")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    done = F.col("outcome").isin("created", "reinforced")
    version = F.when(done, F.coalesce(F.col("e.v"), F.lit(0)) + taken).cast("int")
    most = F.greatest(F.col("e.c"), F.max(F.when(done, F.col("confidence"))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    edge = F.when(F.col("_bad"), None).otherwise(F.coalesce(F.col("e.eid"), first))
    return rows.select(*key, F.col("id").alias("assertion"), edge.alias("id"), "outcome", version.alias("head_version"), "origin", F.when(done, most).alias("confidence"))


def change_edges(rel: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, outcome, head_version, state, review, confidence) of patches (id, action, confidence) to edges: 'retract',
    'confirm' or 'update'. What changes nothing is 'unchanged' and makes no version; an unknown edge is 'missing'."""
    rows = patches.select("id", "action", F.col("confidence").alias("_c")).join(rel.select("id", "head_version", "state", "review", "confidence", F.lit(True).alias("_there")), "id", "left")
    state = F.when(F.col("action") == "retract", "retracted").otherwise(F.col("state"))
    review = F.when(F.col("action") == "confirm", "confirmed").otherwise(F.col("review"))
    sure = F.when(F.col("action") == "update", F.coalesce("_c", "confidence")).otherwise(F.col("confidence"))
    same = state.eqNullSafe(F.col("state")) & review.eqNullSafe(F.col("review")) & sure.eqNullSafe(F.col("confidence"))
    outcome = F.when(F.col("_there").isNull(), "missing").when(same, "unchanged").otherwise("changed")
    version = (F.coalesce("head_version", F.lit(1)) + F.when(outcome == "changed", 1).otherwise(0)).cast("int")
    return rows.select("id", outcome.alias("outcome"), F.when(F.col("_there").isNotNull(), version).alias("head_version"), state.alias("state"), review.alias("review"), sure.alias("confidence"))


def merge_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, aliases, mentions, merged): entities (id, title, aliases, mentions) after others were merged into them by
    mapping (id, into): aliases and names of the merged are united, mentions added up, without the own name."""
    rows = entities.join(mapping.filter("id <> into"), "id", "left").withColumn("_to", F.coalesce("into", "id"))
    names = F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.col("into").isNotNull(), F.array("title")).otherwise(F.array().cast("array<string>")))
    joined = rows.groupBy(F.col("_to").alias("id")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(names)))).alias("a"), F.sum(F.coalesce("mentions", F.lit(0))).alias("mentions"),
        F.sum(F.col("into").isNotNull().cast("int")).alias("merged"), F.max(F.when(F.col("into").isNull(), F.col("title"))).alias("own"),
    )
    return joined.select("id", F.filter("a", lambda x: ~x.eqNullSafe(F.col("own")) & x.isNotNull()).alias("aliases"), "mentions", "merged")


def merge_nodes(rel: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after nodes were merged by (id, into): ends re-pointed, self edges and repeats dropped."""
    m = lambda side: mapping.select(F.col("id").alias(side), F.col("into").alias(f"_{side}"))
    moved = rel.join(m("src_id"), "src_id", "left").join(m("dst_id"), "dst_id", "left")
    moved = moved.select(F.coalesce("_src_id", "src_id").alias("src_id"), "type", F.coalesce("_dst_id", "dst_id").alias("dst_id"))
    return moved.filter("src_id <> dst_id").distinct()
