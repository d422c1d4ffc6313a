"""Usage cost, calibration and estimates."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions.money import required_credits, shortfall, usage_cost
from sitelake.operators.skew import first_n_per_key

# Fixed values.
DEFAULT_CHARS_PER_TOKEN = 4.0
DEFAULT_ITERATIONS = 3
DEFAULT_COMPLETION_TOKENS = 6000
MIN_CALIBRATION_SAMPLES = 3
CALIBRATION_SAMPLES = 20
SEED_PRICES = (
    ("openai/gpt-4o-mini", 0.15, 0.60),
    ("anthropic/claude-sonnet-4.5", 3.0, 15.0),
    ("anthropic/claude-opus-5", 5.0, 25.0),
)


class Tier(NamedTuple):
    """A sales tier as configured: a short list held by the driver, never table data."""

    key: str
    label: str
    sort_order: int
    enabled: bool
    model: str
    download_cost: int = 1


def enabled(tiers: Sequence[Tier]) -> list[Tier]:
    return sorted((t for t in tiers if t.enabled), key=lambda t: t.sort_order)


def tier_array(tiers: Sequence[Tier]) -> Column:
    """Tiers as an array literal; exploding it pairs rows with tiers without any join."""
    structs = [
        F.struct(
            F.lit(t.key).alias("tier"), F.lit(t.sort_order).alias("sort_order"), F.lit(t.model).alias("model_name"),
            F.lit(t.download_cost).alias("download_cost"),
        )
        for t in tiers
    ]
    return F.array(*structs) if structs else F.array().cast("array<struct<tier:string,sort_order:int,model_name:string,download_cost:int>>")


def since(column: str, as_of: str, days: int, kind: str = "timestamp_ntz") -> Column:
    """Relative window starting `days` before `as_of`, as a literal bound of the column's own type so
    that it reaches the file scan."""
    if not 1 <= days <= 365:
        raise ValueError("days must be between 1 and 365")
    bound = F.expr(f"cast(timestamp_ntz'{as_of}' - make_dt_interval({days}) as {kind})")
    return F.col(column) >= bound


def overlay_pricing(seed: DataFrame, override: DataFrame) -> DataFrame:
    """Seed prices with whole rows replaced by the override table, plus models only it knows."""
    s, o = seed.alias("s"), override.withColumn("_there", F.lit(True)).alias("o")

    def pick(name: str) -> Column:
        return F.when(F.col("o._there"), F.col(f"o.{name}")).otherwise(F.col(f"s.{name}")).alias(name)

    return s.join(o, F.col("s.model_name") == F.col("o.model_name"), "full_outer").select(
        F.coalesce("o.model_name", "s.model_name").alias("model_name"),
        pick("prompt_price_per_1m"),
        pick("completion_price_per_1m"),
    )


def with_cost(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Usage rows with their dollar cost; models without a price cost nothing and are flagged."""
    priced = usage.join(pricing, "model_name", "left")
    cost = usage_cost(
        F.col("prompt_tokens"), F.col("completion_tokens"), F.col("prompt_price_per_1m"), F.col("completion_price_per_1m")
    )
    return priced.withColumns({"cost_usd": cost, "priced": F.col("prompt_price_per_1m").isNotNull()}).drop(
        "prompt_price_per_1m", "completion_price_per_1m"
    )


def unpriced_models(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    return usage.select("model_name").distinct().join(pricing, "model_name", "left_anti")


def cost_by(costed: DataFrame, *keys: str) -> DataFrame:
    return costed.groupBy(*keys).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.count("*").alias("calls"),
    )


def usage_by_job(costed: DataFrame) -> DataFrame:
    """Per job: models in first-use order and total cost.

    Reduced to one row per (job, model) first, so the collected list is bounded by the model count.
    """
    per_model = costed.filter("job_id is not null").groupBy("job_id", "model_name").agg(
        F.min(F.struct("created_at", "id")).alias("first_use"), F.sum("cost_usd").alias("cost")
    )
    ordered = F.array_sort(F.collect_list(F.struct("first_use", "model_name")))
    return per_model.groupBy("job_id").agg(
        F.array_join(F.transform(ordered, lambda m: m["model_name"]), ",").alias("models"),
        F.round(F.sum("cost"), 6).alias("cost_usd"),
    )


def run_totals(calls: DataFrame, run: str) -> DataFrame:
    return calls.groupBy(run).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("calls")
    )


def recent_samples(usage: DataFrame, jobs: DataFrame, outputs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Newest 20 generation calls per (model, tier), then the unusable ones dropped: limit before filter."""
    calls = usage.filter("purpose = 'generation'").select("id", "job_id", "model_name", "prompt_tokens", "completion_tokens", "created_at")
    joined = calls.join(jobs.select(F.col("id").alias("job_id"), "project_id", "tier"), "job_id").join(
        outputs.select("job_id", "iterations"), "job_id"
    )
    newest = first_n_per_key(joined, ["model_name", "tier"], [F.col("created_at").desc(), F.col("id").desc()], CALIBRATION_SAMPLES)
    # At most 20 rows per (model, tier) are left when the document sizes are looked up.
    sized = newest.join(sizes, "project_id", "left")
    return sized.filter("prompt_tokens > 0 and design_chars > 0")


def calibration(samples: DataFrame) -> DataFrame:
    """Per (model, tier) token ratios; constants below three samples."""
    stats = samples.groupBy("model_name", "tier").agg(
        F.avg(F.col("design_chars") / F.col("prompt_tokens")).alias("ratio"),
        F.bround(F.avg("iterations"), 0).cast("long").alias("iters"),
        F.bround(F.avg("completion_tokens"), 0).cast("long").alias("completions"),
        F.count("*").alias("samples"),
    )
    enough = F.col("samples") >= MIN_CALIBRATION_SAMPLES
    return stats.select(
        "model_name", "tier", "samples",
        F.when(enough, F.col("ratio")).otherwise(DEFAULT_CHARS_PER_TOKEN).alias("chars_per_token"),
        F.when(enough, F.greatest(F.col("iters"), F.lit(1))).otherwise(DEFAULT_ITERATIONS).alias("iterations"),
        F.when(enough, F.greatest(F.col("completions"), F.lit(1))).otherwise(DEFAULT_COMPLETION_TOKENS).alias("completion_tokens"),
        enough.alias("calibrated"),
    )


def tier_estimates(sites: DataFrame, tiers: Sequence[Tier], calibrated: DataFrame, pricing: DataFrame, max_iterations: int) -> DataFrame:
    """Cost estimate per (site, enabled tier). `sites` carries `site_id` and `design_chars`."""
    fan = sites.select("site_id", "design_chars", F.explode(tier_array(enabled(tiers))).alias("t")).select(
        "site_id", "design_chars", "t.tier", "t.model_name"
    )
    tuned = fan.join(calibrated, ["model_name", "tier"], "left")
    iterations = F.least(F.coalesce("iterations", F.lit(DEFAULT_ITERATIONS)), F.lit(max_iterations))
    prompt_once = F.bround(F.col("design_chars") / F.coalesce("chars_per_token", F.lit(DEFAULT_CHARS_PER_TOKEN)), 0)
    return with_cost(
        tuned.select(
            "site_id", "tier", "model_name",
            (prompt_once.cast("long") * iterations).alias("prompt_tokens"),
            F.coalesce("completion_tokens", F.lit(DEFAULT_COMPLETION_TOKENS)).cast("long").alias("completion_tokens"),
            F.coalesce("calibrated", F.lit(False)).alias("calibrated"),
        ),
        pricing,
    ).drop("priced")


def site_estimates(per_tier: DataFrame) -> DataFrame:
    return per_tier.groupBy("site_id").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count("*").alias("tiers"))


def cost_gate(estimates: DataFrame, tiers: Sequence[Tier], threshold: float) -> DataFrame:
    """Sites over the threshold wait with their tiers snapshotted; the others fan out one row per tier."""
    keys = [t.key for t in enabled(tiers)]
    over = F.col("cost_usd") > threshold
    waiting = estimates.filter(over).select(
        "site_id", F.lit("awaiting_cost_approval").alias("status"), F.lit(",".join(keys)).alias("tier")
    )
    started = estimates.filter(~over).select(
        "site_id", F.lit("generating").alias("status"), F.explode(F.array(*[F.lit(k) for k in keys])).alias("tier")
    )
    return waiting.unionByName(started)


def gate_info(costs: DataFrame, usd_per_credit: float) -> DataFrame:
    """Credits required for `cost_usd` and how many the `balance` lacks."""
    needed = required_credits(F.col("cost_usd"), F.lit(float(usd_per_credit)))
    return costs.withColumn("required_credits", needed).withColumn(
        "shortfall_credits", shortfall(F.col("required_credits"), F.col("balance"))
    )
