"""Summaries, groups and facets of priced usage events. Each is one hash aggregation with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.pricing import COSTS, with_costs

from .filters import SelectionFilter

TOKENS = ("input_tokens", "cached_input_tokens", "uncached_input_tokens", "output_tokens", "reasoning_output_tokens", "other_output_tokens", "canonical_tokens")


def measures() -> list[Column]:
    """Aggregates of a summary. Sums run over exact decimals and are checked when they are narrowed to 64 bits."""
    whole = lambda c: F.coalesce(F.sum(c.cast("decimal(20,0)")), F.lit(0)).cast("long")
    unpriced = F.when(~F.col("priced"), F.col("canonical_tokens")).otherwise(F.lit(0))
    return [
        F.count(F.lit(1)).alias("calls"),
        *[whole(F.col(c)).alias(c) for c in TOKENS],
        whole(unpriced).alias("unpriced_tokens"),
        *[whole(F.col(c)).alias(c) for c in COSTS],
    ]


def first_seen() -> Column:
    """Least (time, rollout, ordinal) of a group: the order in which groups with equal cost are listed."""
    return F.min(F.struct("timestamp_epoch_ms", "rollout_id", "token_event_ordinal")).alias("_first")


def summary(priced: DataFrame) -> DataFrame:
    """One row; zeros for no events."""
    return priced.agg(*measures())


def _by_cost(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("total_nano"), "_first").drop("_first")


def by_model(priced: DataFrame) -> DataFrame:
    return _by_cost(priced.groupBy("category").agg(*measures(), first_seen()))


def by_role(priced: DataFrame) -> DataFrame:
    """By thread type and shown role; threads are conversations for main threads and rollouts for others."""
    thread = F.when(F.col("thread_type") == "main", F.col("conversation_id")).otherwise(F.col("rollout_id"))
    return _by_cost(priced.groupBy("thread_type", "role").agg(F.count_distinct(thread).alias("threads"), *measures(), first_seen()))


def by_agent(priced: DataFrame) -> DataFrame:
    return _by_cost(priced.groupBy("thread_type", "role", "agent_path", "category").agg(*measures(), first_seen()))


def _facet(priced: DataFrame, *keys: str) -> DataFrame:
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("long")
    return priced.groupBy(*keys).agg(total("canonical_tokens").alias("tokens"), total("total_nano").alias("total_nano")).orderBy(*keys)


def model_facet(priced: DataFrame) -> DataFrame:
    return _facet(priced, "category")


def subject_facet(priced: DataFrame) -> DataFrame:
    return _facet(priced, "thread_type", "role")


def dashboard(events: DataFrame, chosen: SelectionFilter) -> dict[str, DataFrame]:
    """All tables of one dashboard: facets respect the time range alone, the rest the whole selection."""
    in_time = with_costs(chosen.in_time(events))
    selected = chosen.apply(in_time)
    return {
        "summary": summary(selected), "by_model": by_model(selected), "by_role": by_role(selected), "by_agent": by_agent(selected),
        "model_facet": model_facet(in_time), "subject_facet": subject_facet(in_time),
    }
