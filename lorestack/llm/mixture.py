"""Mixing sources to target weights.

Method: Pareto order sampling. Each document of a source has an expected number of copies; its whole part is certain,
the rest is its inclusion probability p. Documents are ranked by the odds of a random number divided by the odds of p,
and taken in that order until the source has its tokens.

Scale: sizes are counted in one narrow pass and kept without the texts. Expected copies depend on the source and the
power of two of a document's size only, so they come from a histogram of sources x 64 sizes. The rank at which a source
is full comes from two histograms of 4,096 bins, so no source, however large, is sorted or brought to one task: only
the documents of the last bin (a 16-millionth of the ranks) are put in order. Random numbers are hashes of the document's
id and a seed, so a recomputed task makes the same choices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorestack.llm.tokenizer import VOCABULARY, count_tokens
from lorestack.session import cut
from lorestack.sources.tables import table

BINS = 4096


@dataclass
class Plan:
    """What a source gets: tokens wanted at its weight, tokens it can give, and copies by power of two of the size."""

    source: str
    weight: float
    max_repeats: int
    documents: int
    tokens: int
    target: float
    copies: dict[int, float]


def fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens of each source: shares by weight of `total`; what a capped source can't give goes to the others by weight."""
    out, free, left = {}, dict(weights), total
    while free:
        scale = left / sum(free.values()) if sum(free.values()) > 0 else 0.0
        full = [s for s, w in free.items() if w * scale >= caps[s]]
        if not full:
            return out | {s: w * scale for s, w in free.items()}
        for s in full:
            out[s] = float(caps[s])
            left -= caps[s]
            del free[s]
    return out


def expected_copies(sizes: dict[int, int], target: float, repeats: int, power: float) -> dict[int, float]:
    """Copies of a document by its power of two b: min(repeats, x * 2 ** (power * b)), x such that they have `target` tokens."""
    if target >= repeats * sum(sizes.values()):
        return {b: float(repeats) for b in sizes}
    low, high = 0.0, float(repeats)
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if sum(min(repeats, x * 2.0 ** (power * b)) * t for b, t in sizes.items()) < target else (low, x)
    return {b: min(float(repeats), high * 2.0 ** (power * b)) for b in sizes}


def plan_mixture(sized: DataFrame, targets: DataFrame, power: float) -> list[Plan]:
    """The plans of all listed sources, from a histogram of at most 64 sizes for each."""
    hist = sized.groupBy("source", "power").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
    wanted = {r.source: (float(r.weight or 0), int(r.max_repeats or 0)) for r in targets.select("source", "weight", "max_repeats").distinct().collect()}
    sizes: dict[str, dict[int, int]] = {s: {} for s in wanted}
    counts = dict.fromkeys(wanted, 0)
    for r in hist:
        if r.power >= 0:
            sizes[r.source][r.power] = r.tokens
        counts[r.source] += r.n
    have = {s: sum(x.values()) for s, x in sizes.items()}
    tokens = fill({s: w for s, (w, _) in wanted.items()}, {s: m * have[s] for s, (_, m) in wanted.items()}, sum(have.values()))
    return [Plan(s, w, m, counts[s], have[s], tokens[s], expected_copies(sizes[s], tokens[s], m, power)) for s, (w, m) in sorted(wanted.items())]


def sized_documents(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, power) of the documents of listed sources; power is floor(log2(tokens)), -1 for none."""
    listed = targets.select("source").filter("source is not null").distinct()  # a table of fixed size
    own = documents.select("doc_id", "source", "text").join(F.broadcast(listed), "source", "left_semi")
    sized = count_tokens(own, ["doc_id", "source"], "text", vocabulary)
    return sized.withColumn("power", F.when(F.col("tokens") > 0, F.floor(F.log2(F.col("tokens") + 0.5))).otherwise(-1).cast("int"))


def _taken(ranked: DataFrame, wanted: DataFrame, value: str) -> DataFrame:
    """(source, bin, left): rows of bins below `bin` are all taken, and `left` more tokens from the bin itself."""
    bins = ranked.groupBy("source", F.floor(F.col(value) * BINS).cast("int").alias("bin")).agg(F.sum("tokens").alias("t"))
    running = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = bins.join(F.broadcast(wanted), "source").withColumn("before", running).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest")))
    return at.select("source", F.col("bin").alias("bin"), (F.col("rest") - F.col("before")).alias("left"))


def mix_sources(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, power: float = 0.5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The selection (doc_id, source, tokens, copies >= 1) and the report, one row per listed source.

    Sources get their weight of the tokens of all documents of listed sources. A source that can't reach that, all its
    documents taken max_repeats times, gives what it has; the others share the rest by weight, so the total holds; if
    none can take more the total falls short. A source without documents gets 0. A document's expected copies grow with
    its size to `power`. Sources reach their tokens to within one document. Documents without tokens (null and empty
    texts) are never selected; documents of unlisted or null sources are left out. Equal ranks are ordered by doc_id.
    """
    spark = documents.sparkSession
    sized = cut(sized_documents(documents, targets, vocabulary))
    plans = plan_mixture(sized, targets, power)
    rows = [(p.source, b, int(e), e - int(e)) for p in plans for b, e in p.copies.items()]
    copies = spark.createDataFrame(rows, "source string, power int, whole int, share double")
    # what the certain copies leave to be sampled, at most one row per source
    whole = sized.join(F.broadcast(copies), ["source", "power"])
    sure = {r.source: r.t for r in whole.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("t")).collect()}
    rest = spark.createDataFrame([(p.source, float(p.target - sure.get(p.source, 0))) for p in plans], "source string, rest double")
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    odds = (u / (1 - u)) / (F.col("share") / (1 - F.col("share")))
    ranked = whole.withColumn("rank", F.when(F.col("share") > 1e-12, odds / (1 + odds)))
    drawn = ranked.filter("rank is not null").select("doc_id", "source", "tokens", "rank")
    first = _taken(drawn, rest, "rank").collect()  # at most one row per source
    limits = {r.source: [r.bin, r.left, None, None] for r in first}
    one = spark.createDataFrame([(s, x[0]) for s, x in limits.items()], "source string, bin int")
    inner = drawn.join(F.broadcast(one), "source").filter(F.floor(F.col("rank") * BINS) == F.col("bin")).withColumn("fine", F.col("rank") * BINS - F.col("bin"))
    for r in _taken(inner, spark.createDataFrame([(s, float(x[1])) for s, x in limits.items()], "source string, rest double"), "fine").collect():
        limits[r.source][2:] = [r.bin, r.left]
    edge = spark.createDataFrame([(s, *map(float, (x[0], x[2] if x[2] is not None else BINS, x[3] or 0))) for s, x in limits.items()], "source string, bin double, fine_bin double, left double")
    last = inner.join(F.broadcast(edge.select("source", "fine_bin", "left")), "source").filter(F.floor(F.col("fine") * BINS) == F.col("fine_bin"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the document that crosses the target is taken if that comes closer to it
    more = last.withColumn("before", before).filter(F.col("before") + F.col("tokens") / 2 <= F.col("left")).select("doc_id", F.lit(1).alias("extra"))
    placed = ranked.join(F.broadcast(edge), "source", "left")
    coarse, fine = F.floor(F.col("rank") * BINS), F.floor((F.col("rank") * BINS - F.col("bin")) * BINS)
    # a source whose draws are all used up has no edge: its share is 0 or everything fits
    below = F.coalesce((coarse < F.col("bin")) | ((coarse == F.col("bin")) & (fine < F.col("fine_bin"))), F.lit(False))
    chosen = placed.join(more, "doc_id", "left").withColumn("copies", F.col("whole") + F.when(below, 1).otherwise(0) + F.coalesce("extra", F.lit(0)))
    selection = chosen.filter("copies > 0").select("doc_id", "source", "tokens", F.col("copies").cast("int").alias("copies"))
    plan = spark.createDataFrame(
        [(p.source, p.weight, p.max_repeats, p.documents, p.tokens, float(p.target)) for p in plans],
        "source string, weight double, max_repeats int, documents long, tokens long, target_tokens double",
    )
    used = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("selected_tokens"), F.count("*").alias("selected_documents"), F.max("copies").alias("most_copies"))
    report = plan.join(used, "source", "left").na.fill(0, ["selected_tokens", "selected_documents", "most_copies"])
    total = F.sum("selected_tokens").over(Window.partitionBy(F.lit(1)))
    wanted = F.col("weight") * F.lit(float(sum(p.tokens for p in plans)))
    report = report.withColumn("actual_share", F.when(total > 0, F.col("selected_tokens") / total).otherwise(0.0))
    report = report.withColumn("reached", F.col("max_repeats") * F.col("tokens") >= wanted)
    columns = ["source", F.col("weight").alias("wanted_share"), "actual_share", "reached", "max_repeats", "most_copies", "documents", "selected_documents", "tokens", "target_tokens", "selected_tokens"]
    return selection, report.select(*columns)


def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_target"))[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_target"))[1]


def p8_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """What SQL knows without a tokenizer of each listed source: its documents; and that no document is used more often than
    allowed, that a source without usable documents gives nothing, and that one that reaches its weight has at least it."""
    r = p8_report(spark, folder)
    kept = (F.col("most_copies") <= F.col("max_repeats")) & (F.col("selected_documents") <= F.col("documents"))
    right = ~F.col("reached") | (F.col("actual_share") >= F.col("wanted_share") - 0.002)
    return r.select("source", "documents", "max_repeats", kept.alias("within_caps"), (right & ((F.col("tokens") > 0) | (F.col("selected_tokens") == 0))).alias("shares_right"))


QUERIES = {"p8_selection": p8_selection, "p8_report": p8_report, "p8_bounds": p8_bounds}
SQL = {
    "p8_bounds": "WITH t AS (SELECT DISTINCT source, max_repeats FROM mix_target), d AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT t.source, coalesce(n, 0) AS documents, max_repeats, true AS within_caps, true AS shares_right FROM t LEFT JOIN d USING (source)",
}
