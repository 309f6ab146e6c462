"""Cost, budgets, reuse of finished work and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.functions.exprs import unfold
from obsflow.operators.lookup import rate_lookup
from obsflow.plans.ordered import Ordered, row_number, running_max, running_sum


def request_cost(total: Column, cached: Column, output: Column, r_in: Column, r_cached: Column, r_out: Column, subscription: Column) -> Column:
    reused = F.least(total, cached)
    usd = ((total - reused) * r_in + reused * r_cached + output * r_out) / 1e6
    return F.when(subscription, F.lit(0.0)).otherwise(usd)


def usage_cost(requests: DataFrame, rates: DataFrame, keys, model: str) -> DataFrame:
    """Tokens and estimated cost per key.  ``requests``: input_tokens, cached_input_tokens,
    output_tokens, subscription.  Requests of unknown models are counted in ``errors``."""
    r = rate_lookup(requests, rates, model)
    usd = request_cost(F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens"), F.col("r_in"), F.col("r_cached"), F.col("r_out"), F.col("subscription"))
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"),
        F.sum(F.least("input_tokens", "cached_input_tokens")).alias("cached_input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.coalesce(F.sum(usd), F.lit(0.0)).alias("usd"), F.count_if((F.col("error").isNotNull()) & ~F.col("subscription")).alias("errors"))


def budget_guard(requests: DataFrame, rates: DataFrame, keys, order, model: str, budget: float, max_requests: int | None = None,
                 schema_chars: int = 0, max_output: int = 16000) -> DataFrame:
    """Which requests may be sent: work stops at the first one whose reservation would pass the budget.

    ``requests`` also has prompt_chars and images.
    """
    r = rate_lookup(requests, rates, model)
    usd = request_cost(F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens"), F.col("r_in"), F.col("r_cached"), F.col("r_out"), F.col("subscription"))
    guess = F.col("prompt_chars") / 2 + F.lit(16000) * F.col("images") + F.lit(schema_chars / 2)
    reserve = F.when(F.col("subscription"), 0.0).otherwise((guess * F.col("r_in") + F.lit(max_output) * F.col("r_out")) / 1e6)
    o = Ordered(r.withColumns({"_usd": usd, "_res": reserve}), keys, order)
    o = o.with_columns(_spent=running_sum("_usd", inclusive=False), _rn=row_number())
    over = (F.col("_spent") + F.col("_res") > budget) | (F.col("error").isNotNull() & ~F.col("subscription"))
    if max_requests is not None:
        over = over | (F.col("_rn") > max_requests)
    o = o.columns(_over=F.coalesce(over, F.lit(True))).with_columns(_stop=running_max("_over"))
    return o.columns(allowed=~F.col("_stop")).result.drop("_usd", "_res", "_spent", "_rn", "_over", "_stop", "r_in", "r_cached", "r_out", "error")


COUNTERS = ["requests", "cache_hits", "input_tokens", "cached_input_tokens", "output_tokens", "estimated_usd"]  # Fixed values: counter names.


def merge_worker_usage(df: DataFrame, keys, worker: str, order, counters=COUNTERS) -> DataFrame:
    """Totals with every worker counted once, from its last report."""
    last = df.groupBy(*keys, worker).agg(F.max_by(F.struct(*counters), F.struct(*order)).alias("_c"))
    return last.groupBy(*keys).agg(*[F.sum(F.col("_c")[c]).alias(c) for c in counters])


def resume_plan(batches: DataFrame, journal: DataFrame, keys, batch: str) -> tuple[DataFrame, DataFrame]:
    """Batches still to do, and per key how many are done already."""
    done = journal.select(*keys, batch).distinct().withColumn("_done", F.lit(True))
    j = batches.join(done, [*keys, batch], "left")
    todo = j.filter("_done is null").drop("_done")
    return todo, j.groupBy(*keys).agg(F.count("_done").alias("hits"), F.count_if(F.col("_done").isNull()).alias("todo"))


def state_summary(lines: DataFrame, warnings: DataFrame, keys, flagged: Column, original_missing: Column, removed: Column) -> DataFrame:
    """Counts shown for each project."""
    a = lines.select(*keys, F.lit(1).alias("_l"), flagged.cast("int").alias("_f"), original_missing.cast("int").alias("_m"), removed.cast("int").alias("_r"), F.lit(0).alias("_w"))
    w = warnings.select(*keys, *[F.lit(0).alias(c) for c in ("_l", "_f", "_m", "_r")], F.lit(1).alias("_w"))
    return a.unionByName(w).groupBy(*keys).agg(*[F.sum(c).alias(n) for c, n in (
        ("_l", "lines"), ("_f", "flagged"), ("_m", "original_missing"), ("_r", "removed"), ("_w", "warnings"))])


def preparation_stats(samples: DataFrame, kept: DataFrame, keys, row: list[str], pixels: str, prepared: str) -> DataFrame:
    """Sampled, selected and cropped samples, and pixels before and after."""
    k = kept.select(*keys, *row).withColumn("_k", F.lit(1))
    return samples.join(k, [*keys, *row], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sampled"), F.count("_k").alias("selected"), F.count_if(F.col(prepared) != F.col(pixels)).alias("cropped"),
        F.sum(pixels).alias("source_pixels"), F.sum(prepared).alias("prepared_pixels"))


def warnings_summary(counters: DataFrame, keys, messages: list[tuple[str, str]]) -> DataFrame:
    """One message per non-zero counter, in the given order; ``{n}`` is the count."""
    items = [F.when(F.col(c) > 0, F.struct(F.lit(i).alias("pos"), F.replace(F.lit(m), F.lit("{n}"), F.col(c).cast("string")).alias("message")))
             for i, (c, m) in enumerate(messages)]
    return counters.select(*keys, unfold(F.array_compact(F.array(*items))).alias("_m")).filter("_m is not null").select(*keys, "_m.pos", "_m.message")
