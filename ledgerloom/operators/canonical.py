"""Which of several copies of a session's log is the canonical one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUAL, EXTENSION, SHORTER, DIVERGED = "equal", "extension", "shorter", "diverged"
#: Attributes in which copies must agree; project, title and activity may differ.
ATTRIBUTES = ("conversation_id", "rollout_id", "parent_thread_id", "thread_type", "agent_role", "agent_path", "agent_nickname", "is_realtime_voice")


def identity(with_model: bool = False) -> Column:
    """What makes two events the same: time and tokens, for the semantic comparison also the model."""
    columns = ["timestamp_epoch_ms", *(["model"] if with_model else []), "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"]
    return F.struct(*columns)


def sequences(events: DataFrame, key: str, value: Column) -> DataFrame:
    """key, sequence: a rollout's or file's values in the order of its ordinals. One rollout's events are one session's,
    bounded by its log file."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("token_event_ordinal").alias("o"), value.alias("v"))))
    return events.groupBy(key).agg(F.transform(ordered, lambda x: x["v"]).alias("sequence"))


def sequence_relation(existing: Column, candidate: Column) -> Column:
    """How a candidate's sequence relates to the existing one, by common prefix."""
    a, b = F.size(existing), F.size(candidate)
    n = F.least(a, b)
    prefix = (n == 0) | (F.slice(existing, 1, F.greatest(n, F.lit(1))) == F.slice(candidate, 1, F.greatest(n, F.lit(1))))
    return F.when(~prefix, DIVERGED).when(a == b, EQUAL).when(b > a, EXTENSION).otherwise(SHORTER)


def relations(files: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """path, identity_relation, semantic_relation, ledger_has_events of files (path, rollout_id): how the events `new`
    (path) of each relate to the events `old` of its rollout. Events are compared place by place; no session's events
    are gathered in one value."""

    def placed(events: DataFrame, key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy("token_event_ordinal"))
        return events.select(key, place.alias("place"), identity().alias("i"), identity(True).alias("s"))

    there = files.join(placed(old, "rollout_id"), "rollout_id").select("path", "place", F.col("i").alias("i_old"), F.col("s").alias("s_old"))
    both = placed(new, "path").join(there, ["path", "place"], "full_outer")
    differs = lambda c: F.coalesce(F.max(F.col(c) != F.col(f"{c}_old")), F.lit(False)).alias(f"{c}_differs")
    counts = both.groupBy("path").agg(F.count("i").alias("n"), F.count("i_old").alias("n_old"), differs("i"), differs("s"))
    found = files.select("path").join(counts, "path", "left").na.fill(0, ["n", "n_old"])
    length = F.when(F.col("n") == F.col("n_old"), EQUAL).when(F.col("n") > F.col("n_old"), EXTENSION).otherwise(SHORTER)
    relation = lambda c: F.when(F.coalesce(F.col(f"{c}_differs"), F.lit(False)), DIVERGED).otherwise(length)
    return found.select("path", relation("i").alias("identity_relation"), relation("s").alias("semantic_relation"), (F.col("n_old") > 0).alias("ledger_has_events"))


def decision() -> Column:
    """What happens to a scanned file; the first rule that holds decides. Columns: rebuild, expected_id_matches,
    is_canonical, has_canonical, canonical_present, canonical_in_conflict, recoverable, prefix_rewritten,
    identity_relation, semantic_relation, same_metadata, ledger_has_events."""
    c = F.col
    changed = c("prefix_rewritten") | c("identity_relation").isin(SHORTER, DIVERGED) | c("semantic_relation").isin(SHORTER, DIVERGED) | ~c("same_metadata")
    attribution = ~c("same_metadata") | c("semantic_relation").isin(SHORTER, DIVERGED)
    return (
        F.when(c("rebuild"), F.when(c("expected_id_matches"), "replace").otherwise("reject"))
        .when(~c("is_canonical") & c("canonical_in_conflict") & c("recoverable"), "recover")
        .when(c("is_canonical") & changed, "confirm_and_replace")
        .when(c("identity_relation") == DIVERGED, "conflict")
        .when(c("identity_relation") == SHORTER, "candidate")
        .when(c("ledger_has_events") & ~c("is_canonical") & attribution, "conflict")
        .when((c("identity_relation") == EXTENSION) | ~c("has_canonical") | ~c("canonical_present") | c("is_canonical"), "promote")
        .otherwise("candidate")
    )


def usage_changed() -> Column:
    """Whether a decision changes what queries show. Columns: semantic_relation, same_metadata, either_has_events,
    same_picker, is_realtime_voice."""
    c = F.col
    return (c("semantic_relation") != EQUAL) | (~c("same_metadata") & c("either_has_events")) | (~c("same_picker") & ~c("is_realtime_voice"))


def _first(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("rollout_id").orderBy(*order))).where("_n = 1").drop("_n")


def recovery_choice(candidates: DataFrame) -> DataFrame:
    """Per rollout the file to recover from: extensions first, then the longest stable content, the latest, the path."""
    return _first(candidates, F.desc(F.col("relation") == EXTENSION), F.desc("stable_length"), F.desc("modified_at_epoch_ms"), F.col("file_path"))


def revision_choice(candidates: DataFrame) -> DataFrame:
    """Per rollout the file to rebuild from: the canonical one, else by offset, size, time, path."""
    return _first(candidates, F.desc(F.col("canonical_status") == "canonical"), F.desc("byte_offset"), F.desc("size_bytes"), F.desc("modified_at_epoch_ms"), F.col("file_path"))
