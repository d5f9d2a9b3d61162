"""Numbers and texts of a dashboard as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours at positions 0, 1, 2, ... of the time slider, and the step of hours.
ANCHORS, STEP = (0.5, 12.0, 24.0, 168.0, 336.0), 0.5


def normalized_hours(hours: Column) -> Column:
    """Hours on the slider's range, to the nearest half hour, halves away from zero."""
    return F.round(F.least(F.greatest(hours, F.lit(ANCHORS[0])), F.lit(ANCHORS[-1])) / STEP) * STEP


def position_to_hours(position: Column) -> Column:
    p = F.least(F.greatest(position, F.lit(0.0)), F.lit(float(len(ANCHORS) - 1)))
    out = F.lit(ANCHORS[-1])
    for i in reversed(range(len(ANCHORS) - 1)):
        out = F.when(p < i + 1, F.lit(ANCHORS[i]) + (ANCHORS[i + 1] - ANCHORS[i]) * (p - i)).otherwise(out)
    return normalized_hours(out)


def hours_to_position(hours: Column) -> Column:
    h = normalized_hours(hours)
    out = F.lit(float(len(ANCHORS) - 1))
    for i in reversed(range(len(ANCHORS) - 1)):
        out = F.when(h <= ANCHORS[i + 1], i + (h - ANCHORS[i]) / (ANCHORS[i + 1] - ANCHORS[i])).otherwise(out)
    return out


def adjusted_hours(hours: Column, how: str) -> Column:
    """how: decrease, increase, previous_anchor, next_anchor, minimum or maximum."""
    h = normalized_hours(hours)
    if how in ("decrease", "increase"):
        return normalized_hours(h + (STEP if how == "increase" else -STEP))
    if how == "previous_anchor":
        return F.coalesce(F.greatest(*[F.when(F.lit(a) < h, F.lit(a)) for a in ANCHORS]), F.lit(ANCHORS[0]))
    if how == "next_anchor":
        return F.coalesce(F.least(*[F.when(F.lit(a) > h, F.lit(a)) for a in ANCHORS]), F.lit(ANCHORS[-1]))
    return F.lit({"minimum": ANCHORS[0], "maximum": ANCHORS[-1]}[how])


def custom_range(start: Column, end: Column) -> tuple[Column, Column, Column]:
    """Dates at UTC+8 to start and end in epoch milliseconds, and whether the range is valid (later end)."""
    ms = lambda d: F.unix_millis(d.cast("timestamp")) - 8 * 3_600_000  # noqa: E731  the session's zone is UTC
    return ms(start), ms(end), F.coalesce(end > start, F.lit(False))


def token_text(value: Column) -> Column:
    short = lambda unit, mark: F.concat(F.format_string("%.1f", F.round(value / unit, 1)), F.lit(mark))
    return F.when(value >= 1_000_000_000, short(1e9, "B")).when(value >= 1_000_000, short(1e6, "M")).when(value >= 1_000, short(1e3, "K")).otherwise(F.format_number(value, 0))


def cost_text(usd: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.round(usd, 1), 1))


def multiplier_text(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("×"), F.format_number(F.round(value, 2), 2)), F.lit("—"))


def share(cost: Column, total: Column) -> Column:
    return F.when(total > 0, cost.cast("double") / total.cast("double")).otherwise(0.0)


def share_shown(priced: Column, multiplier: Column) -> Column:
    """Whether a share is shown; a row without price and multiplier shows a dash."""
    return priced | multiplier.isNotNull()


def row_priced(unpriced_tokens: Column, canonical_tokens: Column) -> Column:
    return unpriced_tokens < canonical_tokens


def cost_composition(summary: DataFrame) -> DataFrame:
    """Four slices of a summary's cost: slice, nano, percent."""
    four = ("uncached_nano", "cached_nano", "reasoning_nano", "other_nano")
    pairs = ", ".join(f"'{c.removesuffix('_nano')}', greatest({c}, 0L)" for c in four)
    slices = summary.selectExpr("total_nano", f"stack(4, {pairs}) as (slice, nano)")
    return slices.select("slice", "nano", F.when(F.col("total_nano") > 0, F.col("nano").cast("double") / F.col("total_nano").cast("double") * 100).otherwise(0.0).alias("percent"))


def coverage_text(coverage: Column, gap_start_ms: Column, gap_end_ms: Column) -> Column:
    """continuous, gap (with the gap's times at UTC+8 if known) or baseline as a text."""
    clock = lambda ms: F.date_format(F.timestamp_millis(ms + 8 * 3_600_000), "HH:mm:ss")
    return (
        F.when(coverage == "continuous", "observing")
        .when((coverage == "gap") & gap_start_ms.isNotNull(), F.concat(clock(gap_start_ms), F.lit(" - "), clock(gap_end_ms), F.lit(" not observed")))
        .when(coverage == "gap", "observation gap")
        .otherwise("baseline of this run")
    )


def phase_text(phase: Column) -> Column:
    names = {"syncing": "Synchronising", "watching": "Watching", "partial": "Partly observed", "retrying": "Retrying", "degraded": "Degraded"}
    out = F.when(F.lit(False), "")
    for name, text in names.items():
        out = out.when(phase == name, text)
    return out.otherwise("Stopped")
