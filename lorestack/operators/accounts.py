"""What runs cost: windows of spending, budgets, a cache's worth, models in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorestack.session import lookup_join


def money(micros: Column) -> Column:
    """Millionths of a dollar as text: free, four decimals under a cent, else two."""
    n = F.coalesce(micros, F.lit(0))
    return F.when(n == 0, "free").when(n < 10_000, F.format_string("$%.4f", n / 1e6)).otherwise(F.format_string("$%.2f", n / 1e6))


def age(days: Column) -> Column:
    """A number of days in words."""
    whole = lambda c: F.floor(c + 0.5).cast("string")
    return F.when(days < 45, F.concat(whole(days), F.lit(" days"))).when(days < 365, F.concat(whole(days / 30), F.lit(" months"))).when(days / 365 < 1.75, "about a year").otherwise(F.concat(whole(days / 365), F.lit(" years")))


def spend(runs: DataFrame, now: str) -> DataFrame:
    """(workspace_id, today, month, total): millionths spent since the start of the day, of the month, and ever, at an instant."""
    at = F.lit(now).cast("timestamp_ntz")
    since = lambda unit: F.sum(F.when(F.col("started_at") >= F.date_trunc(unit, at), F.coalesce("cost_micros", F.lit(0))).otherwise(0))
    return runs.groupBy("workspace_id").agg(since("day").alias("today"), since("month").alias("month"), F.coalesce(F.sum("cost_micros"), F.lit(0)).alias("total"))


def check_budget(calls: DataFrame, runs: DataFrame, now: str, per_call: int | None = None, daily: int | None = None, monthly: int | None = None) -> DataFrame:
    """calls (workspace_id, cost_micros, ...) with day_left, month_left and refused: 'call', 'day', 'month' or null (allowed).

    What costs nothing is never refused; a null limit is none."""
    used = spend(runs, now)
    rows = lookup_join(calls, used, ["workspace_id"], "left", spread=F.col("cost_micros"))
    left = lambda limit, c: F.lit(None).cast("long") if limit is None else F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.coalesce(c, F.lit(0)))
    rows = rows.withColumn("day_left", left(daily, "today")).withColumn("month_left", left(monthly, "month"))
    cost = F.coalesce("cost_micros", F.lit(0))
    over = lambda limit: cost > limit
    call = F.lit(False) if per_call is None else over(F.lit(per_call))
    refused = F.when(cost == 0, None).when(call, "call").when(F.coalesce(over(F.col("day_left")), F.lit(False)), "day").when(F.coalesce(over(F.col("month_left")), F.lit(False)), "month")
    return rows.withColumn("refused", refused).drop("today", "month", "total")


def cache_state(puts: DataFrame, now: str, ttl_days: int = 30) -> DataFrame:
    """(workspace_id, key, value, created_at, hits, live) of a cache with puts (workspace_id, key, value, at): the latest put
    of a key holds; every later request for a key that was there counts as a hit; entries end after ttl_days."""
    rows = puts.groupBy("workspace_id", "key").agg(F.max(F.struct("at", "value")).alias("r"), (F.count("*") - 1).alias("hits"))
    alive = F.col("r.at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {ttl_days} days")
    return rows.select("workspace_id", "key", F.col("r.value").alias("value"), F.col("r.at").alias("created_at"), "hits", alive.alias("live"))


def cache_stats(state: DataFrame) -> DataFrame:
    """(workspace_id, entries, hits, reused, hit_rate) of a cache's state."""
    out = state.groupBy("workspace_id").agg(F.count("*").alias("entries"), F.sum("hits").alias("hits"), F.sum((F.col("hits") > 0).cast("int")).alias("reused"))
    return out.withColumn("hit_rate", F.floor(F.col("hits") / (F.col("entries") + F.col("hits")) * 1000 + 0.5) / 1000)


def model_census(vectors: DataFrame, model: Column, vector: str) -> DataFrame:
    """(model, dims, n, mixed): vectors by model and length; mixed where there is more than one, so they can't be compared."""
    c = vectors.filter(F.col(vector).isNotNull()).groupBy(model.alias("model"), F.size(vector).alias("dims")).agg(F.count("*").alias("n"))
    return c.withColumn("mixed", F.lit(c.count() > 1))  # as many rows as models
