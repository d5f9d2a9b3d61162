"""Prices, categories, filters, groups and facets with the constants that define them."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import presentation, pricing
from ledgerloom.operators import ordering, usage
from ledgerloom.operators.filters import LedgerFilter, SelectionFilter

BASE = {
    "rollout_id": "r1", "conversation_id": "c1", "thread_type": "subagent", "agent_role": "worker", "agent_path": "/root/w", "token_event_ordinal": 0, "timestamp_epoch_ms": 1_000, "model": "gpt-5.6-sol",
    "input_tokens": 1_000_000, "cached_input_tokens": 800_000, "output_tokens": 100_000, "reasoning_output_tokens": 70_000,
}
SCHEMA = "rollout_id string, conversation_id string, thread_type string, agent_role string, agent_path string, token_event_ordinal long, timestamp_epoch_ms long, model string, input_tokens long, cached_input_tokens long, output_tokens long, reasoning_output_tokens long"


@pytest.fixture
def events(spark):
    return lambda *changes: spark.createDataFrame([tuple((BASE | c).values()) for c in changes] or [tuple(BASE.values())], SCHEMA)


def _usd(row, name):
    return Decimal(row[name]) / 10**9


def test_long_context_prices(events):
    r = pricing.with_costs(events()).head()
    got = [_usd(r, c) for c in ("uncached_nano", "cached_nano", "reasoning_nano", "other_nano", "total_nano", "baseline_nano", "premium_nano")]
    assert got == [Decimal(x) for x in ("2", "0.8", "3.15", "1.35", "7.3", "4.4", "2.9")]
    exact = pricing.with_costs(events()).select(pricing.usd(F.col("total_nano")).alias("u"), pricing.multiplier(F.col("total_nano"), F.col("baseline_nano")).alias("m")).head()
    assert exact.u == Decimal("7.3") and abs(exact.m - 7.3 / 4.4) < 1e-12


def test_threshold_and_eligibility(events):
    rows = pricing.with_costs(events({"input_tokens": 272_000, "cached_input_tokens": 0}, {"input_tokens": 272_001, "cached_input_tokens": 0}, {"model": "gpt-5.4-mini"}, {"model": "gpt-5.4-nano"})).collect()
    assert [r.premium_nano > 0 for r in rows] == [False, True, False, False]


@pytest.mark.parametrize("model,category,priced", [
    ("unknown", "Unknown attribution", False), ("codex-auto-review", "codex-auto-review", False), ("gpt-5.6", "gpt-5.6", True), ("gpt-5.6-preview", "gpt-5.6-preview", False),
    ("gpt-5.60", "Others", True), ("GPT-5.6", "Others", True), ("o3", "Others", True), ("gpt-5.4-mini", "gpt-5.4-mini", True), ("gpt-5.5-x", "gpt-5.5-x", False),
])
def test_categories(events, model, category, priced):
    r = pricing.with_costs(events({"model": model})).head()
    assert (r.category, r.priced) == (category, priced)
    s = usage.summary(pricing.with_costs(events({"model": model}))).head()
    assert s.unpriced_tokens == (0 if priced else 1_100_000) and (s.total_nano > 0) == (model in pricing.RATES)


def test_empty_summary_is_zero(events):
    r = usage.summary(pricing.with_costs(events().where("false"))).head()
    assert set(r.asDict().values()) == {0}


def test_empty_lists_have_two_meanings(events):
    df = events({"model": "o3"}, {"thread_type": "main", "agent_role": "main"})
    assert LedgerFilter(models=(), roles=None).apply(df).count() == 2
    assert SelectionFilter(0, 2_000, models=None).apply(df).count() == 2
    assert SelectionFilter(0, 2_000, models=()).apply(df).count() == 0 and SelectionFilter(0, 2_000, subjects=()).apply(df).count() == 0
    assert SelectionFilter(0, 2_000, subjects=(("main", "root"),)).apply(df).count() == 1
    assert LedgerFilter(roles=("main",)).apply(df).count() == 1
    assert SelectionFilter(0, 1_000).apply(df).count() == 0 and SelectionFilter(1_000, 1_001).apply(df).count() == 2


@pytest.mark.parametrize("bad", [{"start_ms": -1}, {"start_ms": 5, "end_ms": 4}, {"models": (" ",)}, {"thread_types": ("other",)}])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        LedgerFilter(**bad)


def test_facets_ignore_the_selection(events):
    df = events({}, {"model": "o3"}, {"thread_type": "main", "agent_role": "main", "model": "gpt-5.5"})
    tables = usage.dashboard(df, SelectionFilter(0, 2_000, models=("gpt-5.5",)))
    assert tables["summary"].head().calls == 1
    assert [r.category for r in tables["model_facet"].collect()] == ["Others", "gpt-5.5", "gpt-5.6-sol"]
    assert [(r.thread_type, r.role) for r in tables["subject_facet"].collect()] == [("main", "root"), ("subagent", "worker")]


def test_threads_count_conversations_for_main(events):
    main = {"thread_type": "main", "agent_role": "main"}
    df = events(main, main | {"rollout_id": "r2"}, {"rollout_id": "r3"}, {"rollout_id": "r4"})
    rows = {r.role: r.threads for r in usage.by_role(pricing.with_costs(df)).collect()}
    assert rows == {"root": 1, "worker": 2}


def test_groups_are_listed_by_cost_then_first_event(events):
    df = events({"model": "o3", "timestamp_epoch_ms": 5}, {"model": "unknown", "timestamp_epoch_ms": 3}, {"model": "gpt-5.5"})
    assert [r.category for r in usage.by_model(pricing.with_costs(df)).collect()] == ["gpt-5.5", "Unknown attribution", "Others"]


def test_overflow_fails(events):
    big = {"input_tokens": 2**62, "cached_input_tokens": 0, "model": "o3", "output_tokens": 0, "reasoning_output_tokens": 0}
    with pytest.raises(Exception, match="OVERFLOW"):
        usage.summary(pricing.with_costs(events(big, big, big))).collect()


def test_display_orders(spark):
    rows = spark.createDataFrame([("subagent", "scout", 5), ("main", "root", 5), ("subagent", "odd", 5), ("subagent", "worker", 9)], "thread_type string, role string, total_nano long")
    assert [r.role for r in ordering.order_roles(rows).collect()] == ["worker", "root", "scout", "odd"]
    models = spark.createDataFrame([("Others",), ("gpt-5.4",), ("gpt-5.6-sol",), ("codex-auto-review",)], "category string")
    assert [r.category for r in ordering.order_models(models).collect()] == ["gpt-5.6-sol", "codex-auto-review", "Others", "gpt-5.4"]


def test_time_scale(spark):
    at = lambda x: spark.range(1).select(presentation.position_to_hours(F.lit(float(x)))).head()[0]
    assert [at(x) for x in (-1, 0, 0.5, 1, 2, 2.5, 3, 4, 9)] == [0.5, 0.5, 6.5, 12, 24, 96, 168, 336, 336]
    back = lambda x: spark.range(1).select(presentation.hours_to_position(F.lit(float(x)))).head()[0]
    assert [back(x) for x in (0.5, 12, 24, 168, 336)] == [0, 1, 2, 3, 4]
    step = lambda h, how: spark.range(1).select(presentation.adjusted_hours(F.lit(float(h)), how)).head()[0]
    assert [step(12, w) for w in ("decrease", "increase", "previous_anchor", "next_anchor", "minimum", "maximum")] == [11.5, 12.5, 0.5, 24, 0.5, 336]


def test_texts(spark):
    r = spark.range(1).select(
        presentation.token_text(F.lit(1234)).alias("a"), presentation.token_text(F.lit(2_500_000)).alias("b"), presentation.token_text(F.lit(999)).alias("c"), presentation.cost_text(F.lit(1234.56)).alias("d"),
        presentation.multiplier_text(F.lit(1.659)).alias("e"), presentation.multiplier_text(F.lit(None).cast("double")).alias("f"), presentation.phase_text(F.lit("watching")).alias("g"), presentation.coverage_text(F.lit("gap"), F.lit(0), F.lit(61_000)).alias("h"),
    ).head()
    assert list(r) == ["1.2K", "2.5M", "999", "$1,234.6", "×1.66", "—", "Watching", "08:00:00 - 08:01:01 not observed"]
