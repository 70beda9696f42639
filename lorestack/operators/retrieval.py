"""Lexical retrieval and rank fusion as plans over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.session import cut, lookup_join

#: Weight of a term in the title against one in the text, and the saturation of term frequency.
TITLE_WEIGHT, K1, B = 3, 1.2, 0.75
#: Terms of a batch of queries up to which they are compared in place; beyond, they are joined.
FEW_TERMS = 500


def bm25(docs: DataFrame, key: str, title: Column, text: Column, queries: DataFrame, k: int = 10, prefix: bool = False) -> DataFrame:
    """(query_id, key, score, rank): the k best documents of each query (query_id, query), all queries in one plan.

    With `prefix` a term of a query stands for all words that begin with it (for batches of up to FEW_TERMS terms).
    Terms that no query has are dropped before the shuffle; document frequencies and lengths are over all documents.
    The queries are broadcast below a checked size. Rank by score rounded to 6 places, then key."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(T.words(F.col("query")))).alias("term"))
    few = [r.term for r in wanted.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    rows = docs.select(F.col(key).alias("key"), T.words(title).alias("a"), T.words(text).alias("b")).withColumn("len", F.size("a") + F.size("b"))
    if prefix and len(few) > FEW_TERMS:
        raise ValueError(f"prefixes are looked for in batches of up to {FEW_TERMS} terms")
    if len(few) <= FEW_TERMS:  # texts are read once, and only what the queries ask for is kept of them
        asked = F.array(*map(F.lit, few)).cast("array<string>")
        starts = lambda t: F.filter(asked, lambda q: F.startswith(t, q))
        own = lambda c: F.flatten(F.transform(c, starts)) if prefix else F.filter(c, lambda t: t.isin(few))
        rows = cut(rows.select("key", "len", own("a").alias("a"), own("b").alias("b")))
    sizes = rows.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")).first()  # two numbers
    n, average = sizes.n_docs, sizes.avg_len or 1.0
    head = rows.select("key", "len", F.explode("a").alias("term"), F.lit(TITLE_WEIGHT).alias("w"))
    every = head.unionByName(rows.select("key", "len", F.explode("b").alias("term"), F.lit(1).alias("w")))
    hits = lookup_join(every, wanted.select("term").distinct(), ["term"], "left_semi").groupBy("key", "len", "term").agg(F.sum("w").alias("w"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = F.col("w") * (K1 + 1) / (F.col("w") + K1 * ((1 - B) + B * F.col("len") / F.lit(average)))
    scored = lookup_join(lookup_join(hits, df, ["term"]), wanted, ["term"], spread=F.col("key")).groupBy("query_id", "key").agg(F.round(F.sum(idf * weight), 6).alias("score"))
    own_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(own_rank)).filter(F.col("rank") <= k)


def fuse(lists: dict[str, tuple[DataFrame, float]], k0: int = 60) -> DataFrame:
    """(key, score): reciprocal rank fusion of ranked lists (key, rank) with weights."""
    parts = None
    for df, weight in lists.values():
        part = df.select("key", (F.lit(weight) / (k0 + F.col("rank"))).alias("s"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("key").agg(F.sum("s").alias("score"))


def quality() -> Column:
    """How far an object is to be trusted, from review, epistemic, origin, confidence, state and `evidence`."""
    review = F.when(F.col("review") == "confirmed", 1.25).when(F.col("review") == "rejected", 0.4).otherwise(1.0)
    kinds = {"fact": 1.15, "observation": 1.05, "conclusion": 1.05, "inference": 0.95, "hypothesis": 0.9, "speculation": 0.75}
    epistemic = F.lit(1.0)
    for name, value in kinds.items():
        epistemic = F.when(F.col("epistemic") == name, value).otherwise(epistemic)
    origin = F.when(F.col("origin") == "user", 1.1).when((F.col("origin") == "ai") & (F.col("review") == "unreviewed"), 0.85).otherwise(1.0)
    sure = F.coalesce(0.7 + 0.3 * F.col("confidence"), F.lit(1.0))
    proven = 1 + F.least(F.lit(0.2), 0.05 * F.coalesce("evidence", F.lit(0)))
    state = F.when(F.col("state") == "superseded", 0.5).when(F.col("state") == "archived", 0.7).otherwise(1.0)
    return review * epistemic * origin * sure * proven * state


def days_since(at: Column, now: str) -> Column:
    return F.datediff(F.lit(now).cast("date"), F.to_date(at))


def recency(at: Column, now: str, half_life: float = 180.0) -> Column:
    return 0.85 + 0.15 * F.pow(F.lit(0.5), F.greatest(F.lit(0), days_since(at, now)) / half_life)


def salience(now: str) -> Column:
    """Prominence from access_count, last_access, `degree`, `evidence` and review, in [0, 1]."""
    used = 0.32 * F.least(F.lit(1.0), F.log1p(F.coalesce("access_count", F.lit(0))) / F.log(F.lit(41.0)))
    fresh = F.coalesce(0.18 * F.pow(F.lit(0.5), F.greatest(F.lit(0), days_since(F.col("last_access"), now)) / 60.0), F.lit(0.0))
    linked = 0.25 * F.least(F.lit(1.0), F.coalesce("degree", F.lit(0)) / 8) + 0.15 * F.least(F.lit(1.0), F.coalesce("evidence", F.lit(0)) / 4)
    return used + fresh + linked + F.when(F.col("review") == "confirmed", 0.1).otherwise(0.0)


def proximity(terms: Column, query: list[str]) -> Column:
    """Coverage of the query's terms and how near their first positions are, in [0, 1]; 0.125 where none occurs."""
    at = F.filter(F.array(*[F.array_position(terms, q) for q in query]), lambda p: p > 0)
    hits = F.size(at)
    near = F.when(hits < 2, 0.5).otherwise(1 / (1 + (F.array_max(at) - F.array_min(at)) / hits / 10))
    return hits / len(query) * 0.75 + near * 0.25
