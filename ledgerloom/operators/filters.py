"""Filters of the ledger query and of the in-memory query; all are predicates that reach the Parquet scan where a
column is stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.pricing import model_category, normalized_role

THREAD_TYPES = ("main", "subagent", "unknown")


@dataclass(frozen=True)
class LedgerFilter:
    """What the ledger is asked for. None and empty lists both mean: no filter."""

    start_ms: int | None = None
    end_ms: int | None = None
    models: tuple[str, ...] | None = None
    roles: tuple[str, ...] | None = None
    thread_types: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if any(x is not None and x < 0 for x in (self.start_ms, self.end_ms)):
            raise ValueError("bounds must not be negative")
        if self.start_ms is not None and self.end_ms is not None and self.end_ms < self.start_ms:
            raise ValueError("the end lies before the start")
        for values in (self.models, self.roles):
            if values and any(not v.strip() for v in values):
                raise ValueError("a list holds a blank item")
        if self.thread_types and set(self.thread_types) - set(THREAD_TYPES):
            raise ValueError("unknown thread type")

    def predicates(self) -> list[Column]:
        out = []
        if self.start_ms is not None:
            out.append(F.col("timestamp_epoch_ms") >= self.start_ms)
        if self.end_ms is not None:
            out.append(F.col("timestamp_epoch_ms") < self.end_ms)
        for column, values in (("model", self.models), ("agent_role", self.roles), ("thread_type", self.thread_types)):
            if values:
                out.append(F.col(column).isin(list(values)))
        return out

    def apply(self, events: DataFrame) -> DataFrame:
        for p in self.predicates():
            events = events.where(p)
        return events


@dataclass(frozen=True)
class SelectionFilter:
    """What a dashboard selects. None means no filter, an empty list matches nothing."""

    start_ms: int
    end_ms: int
    models: tuple[str, ...] | None = None
    subjects: tuple[tuple[str, str], ...] | None = None

    def __post_init__(self) -> None:
        if self.end_ms <= self.start_ms:
            raise ValueError("the end does not lie after the start")

    def in_time(self, events: DataFrame) -> DataFrame:
        return events.where((F.col("timestamp_epoch_ms") >= self.start_ms) & (F.col("timestamp_epoch_ms") < self.end_ms))

    def apply(self, events: DataFrame) -> DataFrame:
        """Time, model categories and (thread type, shown role) pairs."""
        events = self.in_time(events)
        if self.models is not None:
            events = events.where(model_category(F.col("model")).isin(list(self.models)))
        if self.subjects is not None:
            pair = F.struct(F.col("thread_type"), normalized_role(F.col("thread_type"), F.col("agent_role")))
            events = events.where(pair.isin([F.struct(F.lit(t), F.lit(r)) for t, r in self.subjects]) if self.subjects else F.lit(False))
        return events
