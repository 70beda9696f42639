"""Entities: names that texts mention, and entities that may be one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.operators.blocks import block_pairs
from lorestack.session import cut, lookup_join

#: What an extractor's type makes of an entity; values (dates, money, addresses) are none.
ENTITY_TYPE = {"name": "person", "organisation": "organisation", "identifier": "identifier", "place": "place", "product": "product", "project": "project", "concept": "concept"}


def entity_type(found: Column) -> Column:
    """The entity type of an extractor's type; null for what is no entity."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ENTITY_TYPE.items() for x in pair]), found)


def segments(name: str) -> list[str]:
    """Keys of a name such that two names within the edits that their length allows share one.

    One edit is allowed from 7 characters and two from 14 (a similarity of 0.85). Of t + 1 segments of the shorter name
    one is untouched and stands in the other at most as far off as the edits before and after it allow."""
    n, out = len(name), set()
    for size in range(max(1, n - 2), n + 3):
        edits = 2 if max(n, size) >= 14 else 1 if max(n, size) >= 7 else 0
        off = n - size
        if abs(off) > edits:
            continue
        for i in range(edits + 1):
            start, end = i * size // (edits + 1), (i + 1) * size // (edits + 1)
            low, high = max(start - i, start + off - (edits - i)), min(start + i, start + off + (edits - i))
            for at in range(max(0, low), min(high, n - (end - start)) + 1):
                out.add(f"{size}.{edits}.{i}.{name[at : at + end - start]}")
    return sorted(out)


def duplicate_candidates(entities: DataFrame, least: float = 0.7) -> DataFrame:
    """(id_a, id_b, score), id_a < id_b: entities (id, workspace_id, entity_type, title) of one workspace and type whose
    names compare to at least `least`.

    All pairs that can reach it meet: names with one first word, names with one last word, and names within two edits,
    by the segments that edits leave. Names that are empty when canonical meet nothing; null types are one type."""
    names = entities.select("id", F.col("workspace_id").alias("ws"), F.coalesce("entity_type", F.lit("")).alias("t"), T.canonicalise(F.col("title")).alias("c")).filter("c <> ''")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, c in enumerate(batch.column(3).to_pylist()):
                words = c.split(" ")
                found = ["f" + words[0], "l" + words[-1], *("s" + k for k in segments(c))]
                at.extend([i] * len(found))
                out.extend(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int32())) for k in range(4)), pa.array(out, pa.string())], ["id", "ws", "t", "c", "key"])

    keyed = cut(names.mapInArrow(keys, "id string, ws string, t string, c string, key string"))
    pairs = block_pairs(keyed, ["ws", "t", "key"], "id", ["c"])
    scored = pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), T.compare_names(F.col("c_a"), F.col("c_b")).alias("score"))
    return scored.filter(F.col("score") >= least)


def mentions(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, entity_id, n): how often texts (id, workspace_id, text) name entities (id, workspace_id, title, aliases) of their
    workspace, by the words of the title or an alias in a row.

    Names of any number of words count. Only runs that begin with the first word of some name are made: first words are
    broadcast below a checked size, else joined; so next to nothing but true mentions is shuffled."""
    names = entities.select(F.col("id").alias("entity_id"), "workspace_id", F.explode(F.array_union(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    names = names.select("entity_id", "workspace_id", T.words(F.col("n")).alias("w")).filter(F.size("w") > 0)
    names = cut(names.select("entity_id", "workspace_id", F.array_join("w", " ").alias("name"), F.col("w")[0].alias("first"), F.size("w").alias("k")).distinct())
    starts = names.groupBy("workspace_id", "first").agg(F.collect_set("k").alias("sizes"))
    at = texts.select("id", "workspace_id", T.words(F.col("text")).alias("w"))
    words = at.select("id", "workspace_id", F.posexplode("w").alias("pos", "first"), "w")
    runs = lookup_join(words, starts, ["workspace_id", "first"], spread=F.col("id"))
    runs = runs.select("id", "workspace_id", F.explode("sizes").alias("k"), "pos", "w").filter(F.col("pos") + F.col("k") <= F.size("w"))
    runs = runs.select("id", "workspace_id", F.array_join(F.slice("w", F.col("pos") + 1, F.col("k")), " ").alias("name"))
    counted = runs.groupBy("id", "workspace_id", "name").agg(F.count("*").alias("n"))
    hits = lookup_join(counted, names.select("workspace_id", "name", "entity_id"), ["workspace_id", "name"], spread=F.col("id"))
    return hits.filter(F.col("id") != F.col("entity_id")).groupBy("id", "entity_id").agg(F.sum("n").alias("n"))


def resolve(names: DataFrame, entities: DataFrame) -> DataFrame:
    """names (name_id, workspace_id, name, entity_type) with entity_id: the oldest active or archived entity (id,
    workspace_id, title, aliases, entity_type, state, created_at) of the workspace whose title or an alias is the name when
    canonical. Types must agree where both are known. Names without an entity have a null entity_id."""
    known = entities.filter(F.col("state").isin("active", "archived"))
    keyed = known.select(F.col("id").alias("_e"), F.col("workspace_id").alias("_w"), F.col("entity_type").alias("_t"), F.col("created_at").alias("_at"), F.explode(F.array_union(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_n"))
    keyed = keyed.select("_e", "_w", "_t", "_at", T.canonicalise(F.col("_n")).alias("_k")).filter("_k <> ''").distinct()
    asked = names.withColumn("_k", T.canonicalise(F.col("name"))).withColumn("_w", F.col("workspace_id"))
    fits = lookup_join(asked.select("name_id", "entity_type", "_w", "_k"), keyed, ["_w", "_k"], spread=F.col("name_id"))
    fits = fits.filter(F.col("_t").isNull() | F.col("entity_type").isNull() | (F.col("_t") == F.col("entity_type")))
    oldest = fits.groupBy("name_id").agg(F.min(F.struct("_at", "_e")).alias("o")).select("name_id", F.col("o._e").alias("entity_id"))
    return names.join(oldest, "name_id", "left")


def link_mentions(candidates: DataFrame, entities: DataFrame, least: float = 0.6) -> DataFrame:
    """(object_id, entity_id, entity_type, name, confidence, created): candidates (object_id, workspace_id, text, type,
    confidence) resolved to entities; each entity once per object, at its highest confidence.

    What is no entity or under `least` is left out. Names that no entity has yet are given one id per workspace, type and
    canonical name (created = true)."""
    rows = candidates.select("object_id", "workspace_id", F.col("text").alias("name"), entity_type(F.col("type")).alias("entity_type"), "confidence").filter((F.col("confidence") >= least) & F.col("entity_type").isNotNull())
    rows = rows.withColumn("_k", T.canonicalise(F.col("name"))).filter("_k <> ''")
    names = rows.groupBy("workspace_id", "entity_type", "_k").agg(F.min("name").alias("name"))
    names = names.withColumn("name_id", F.sha2(F.concat_ws("\x1f", "workspace_id", "entity_type", "_k"), 256))
    found = resolve(names.select("name_id", "workspace_id", "entity_type", "_k", "name"), entities)
    fresh = F.concat(F.lit("new_"), F.substring("name_id", 1, 16))
    known = found.select("workspace_id", "entity_type", "_k", F.coalesce("entity_id", fresh).alias("entity_id"), F.col("entity_id").isNull().alias("created"))
    linked = lookup_join(rows, known, ["workspace_id", "entity_type", "_k"], spread=F.col("object_id")).filter(F.col("object_id") != F.col("entity_id"))
    best = F.max_by(F.struct("entity_type", "name", "confidence", "created"), F.struct("confidence", "name")).alias("b")
    return linked.groupBy("object_id", "entity_id").agg(best).select("object_id", "entity_id", "b.*")
