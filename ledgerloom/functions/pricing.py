"""Model categories and exact money.

Costs are whole nano-USD: a rate in nano-USD a token times tokens. Long-context multipliers (x2 on input, x3/2 on
output) keep all listed rates whole. Everything is built-in Column arithmetic inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nano-USD a token for input, cached input, output.
RATES = {
    "gpt-5.6": (5000, 500, 30000),
    "gpt-5.6-sol": (5000, 500, 30000),
    "gpt-5.6-terra": (2000, 200, 12000),
    "gpt-5.6-luna": (200, 20, 1200),
    "gpt-5.5": (5000, 500, 30000),
    "gpt-5.4": (2500, 250, 15000),
    "gpt-5.4-mini": (750, 75, 4500),
    "gpt-5.4-nano": (200, 20, 1250),
}
# Families whose members keep their name, models with long-context prices, threshold of input tokens.
FAMILIES = ("gpt-5.6", "gpt-5.5", "gpt-5.4")
LONG_CONTEXT = ("gpt-5.6", "gpt-5.6-sol", "gpt-5.6-terra", "gpt-5.6-luna", "gpt-5.5", "gpt-5.4")
LONG_CONTEXT_ABOVE = 272_000
OTHERS, AUTO_REVIEW, UNKNOWN = "Others", "codex-auto-review", "Unknown attribution"

COSTS = ("uncached_nano", "cached_nano", "reasoning_nano", "other_nano", "total_nano", "baseline_nano", "premium_nano")


def model_category(model: Column) -> Column:
    """Display category of a source model; case-sensitive."""
    in_family = reduce(lambda a, b: a | b, [(model == f) | model.startswith(f + "-") for f in FAMILIES])
    return F.when(model == "unknown", UNKNOWN).when(model == AUTO_REVIEW, AUTO_REVIEW).when(in_family, model).otherwise(OTHERS)


def normalized_role(thread_type: Column, role: Column) -> Column:
    """Main threads show as `root`, others under their observed role."""
    return F.when(thread_type == "main", "root").otherwise(role)


def _rate(model: Column, position: int) -> Column:
    cases = F.when(F.lit(False), F.lit(0).cast("long"))
    for name, rates in RATES.items():
        cases = cases.when(model == name, F.lit(rates[position]).cast("long"))
    return cases


def is_priced(model: Column) -> Column:
    """Others cost nothing and count as priced; auto-review, unknown and unlisted family members have no price."""
    return (model_category(model) == OTHERS) | model.isin(list(RATES))


def with_costs(events: DataFrame) -> DataFrame:
    """events with category, role, priced, derived token counts and the seven cost columns in nano-USD."""
    model, tokens = F.col("model"), F.col
    long_ = (tokens("input_tokens") > LONG_CONTEXT_ABOVE) & model.isin(list(LONG_CONTEXT))
    base = events.select(
        "*",
        model_category(model).alias("category"),
        normalized_role(F.col("thread_type"), F.col("agent_role")).alias("role"),
        is_priced(model).alias("priced"),
        (tokens("input_tokens") - tokens("cached_input_tokens")).alias("uncached_input_tokens"),
        (tokens("output_tokens") - tokens("reasoning_output_tokens")).alias("other_output_tokens"),
        (tokens("input_tokens") + tokens("output_tokens")).alias("canonical_tokens"),
        *[F.coalesce(_rate(model, i), F.lit(0).cast("long")).alias(f"_r{i}") for i in range(3)],
        long_.alias("long_context"),
    )
    parts = base.select(
        "*",
        (F.col("uncached_input_tokens") * F.col("_r0")).alias("_b0"),
        (F.col("cached_input_tokens") * F.col("_r1")).alias("_b1"),
        (F.col("reasoning_output_tokens") * F.col("_r2")).alias("_b2"),
        (F.col("other_output_tokens") * F.col("_r2")).alias("_b3"),
    )
    up = lambda c, times, over: F.when(F.col("long_context"), F.expr(f"{c} * {times} div {over}")).otherwise(F.col(c))
    priced = parts.select(
        "*", up("_b0", 2, 1).alias("uncached_nano"), up("_b1", 2, 1).alias("cached_nano"), up("_b2", 3, 2).alias("reasoning_nano"), up("_b3", 3, 2).alias("other_nano"),
        F.expr("_b0 + _b1 + _b2 + _b3").alias("baseline_nano"),
    )
    total = F.expr("uncached_nano + cached_nano + reasoning_nano + other_nano")
    done = priced.withColumn("total_nano", total).withColumn("premium_nano", F.col("total_nano") - F.col("baseline_nano"))
    return done.drop(*[f"_r{i}" for i in range(3)], *[f"_b{i}" for i in range(4)])


def usd(nano: Column) -> Column:
    """Exact USD from nano-USD."""
    return (nano.cast("decimal(28,0)") * F.lit("0.000000001").cast("decimal(9,9)")).cast("decimal(38,9)")


def multiplier(total: Column, baseline: Column) -> Column:
    """Actual over baseline cost; null unless the baseline is positive."""
    return F.when(baseline > 0, total.cast("double") / baseline.cast("double"))
