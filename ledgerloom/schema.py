"""Schemas of the ledger's tables and of parsed log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 7

EVENTS = (
    "rollout_id string, token_event_ordinal long, timestamp_epoch_ms long, model string, input_tokens long, cached_input_tokens long, "
    "output_tokens long, reasoning_output_tokens long, event_signature string"
)
ROLLOUTS = (
    "rollout_id string, conversation_id string, parent_thread_id string, thread_type string, agent_role string, agent_path string, "
    "agent_nickname string, is_realtime_voice boolean, project_name string, thread_title string, last_activity_epoch_ms long, "
    "canonical_source_path string, created_at_epoch_ms long, updated_at_epoch_ms long"
)
SOURCES = (
    "file_path string, rollout_id string, size_bytes long, modified_at_epoch_ms long, byte_offset long, prefix_hash string, "
    "prefix_status string, canonical_status string, is_present boolean, last_scanned_at_epoch_ms long, last_error string"
)
CHECKPOINTS = (
    "file_path string, rollout_id string, format_revision int, parser_revision int, source_identity string, observed_size long, "
    "observed_modified_ms long, stable_offset long, boundary_hash string, state_json string, state_hash string"
)
RUNS = "run_id string, trigger string, status string, started_at_epoch_ms long, heartbeat_at_epoch_ms long, completed_at_epoch_ms long, files_seen long, files_changed long, error string"
DIAGNOSTICS = "diagnostic_id long, run_id string, file_path string, severity string, code string, message string, details_json string, created_at_epoch_ms long"
STATE = "key string, value string, updated_at_epoch_ms long"
TABLES = {
    "rollouts": ROLLOUTS, "usage_events": EVENTS, "source_files": SOURCES, "rollout_checkpoints": CHECKPOINTS,
    "collector_runs": RUNS, "collector_diagnostics": DIAGNOSTICS, "collector_state": STATE,
}

#: What each version added, with the default of rows that were written before.
ADDED = (
    (2, "rollouts", "is_realtime_voice", False), (5, "rollouts", "thread_title", ""), (5, "rollouts", "last_activity_epoch_ms", 0), (6, "rollouts", "project_name", "Codex"),
)

#: Record classes of a log line. The first two are harmless, `object` is parsed, the others condemn their file.
HARMLESS, OBJECT = ("blank", "null_padding", "oversized_opaque"), "object"

_SIMPLE = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def struct(ddl: str) -> T.StructType:
    """The schema of a comma-separated list of names and simple types; needs no session."""
    return T.StructType([T.StructField(name, _SIMPLE[kind]) for name, kind in (part.split() for part in ddl.split(","))])


_TUPLE = struct("input long, cached long, output long, reasoning long, total long")
_META = struct("session_id string, id string, thread_source string, has_spawn boolean, cwd string, forked_from_id string, parent_thread_id string, agent_role string, agent_path string, agent_nickname string")
RECORDS = (
    struct(
        "path string, line long, class string, type string, ts string, has_payload boolean, payload_type string, turn_id string, model string, "
        "settings_model string, started_at long, trigger boolean, recipient string, internal_turn_id string"
    )
    .add("usage", _TUPLE)
    .add("total", _TUPLE)
    .add("meta", _META)
)


def version_of(folder: str) -> int:
    """The version that a folder of the ledger was written with; folders of the first ledgers do not say."""
    tag = next((p for p in folder.split("/")[1].split("-") if p[:1] == "v" and p[1:].isdigit()), f"v{VERSION}") if "/" in folder else f"v{VERSION}"
    return int(tag[1:])


def upgraded(spark: SparkSession, table: str, version: int, folders: list[str]) -> DataFrame:
    """The table in these folders as the present version has it: a projection a version, each adding its columns with their
    defaults. A column that no version explains is null."""
    wanted = struct(TABLES[table])
    later = [(v, column, default) for v, t, column, default in ADDED if t == table and v > version]
    df = spark.read.schema(T.StructType([f for f in wanted if f.name not in {c for _, c, _ in later}])).parquet(*folders)
    for _, column, default in sorted(later):
        df = df.withColumn(column, F.lit(default).cast(wanted[column].dataType))
    return df.select(*wanted.fieldNames())


def invalid_event() -> Column:
    """Whether an event breaks a rule of the ledger."""
    counts = [F.col(c) for c in ("token_event_ordinal", "timestamp_epoch_ms", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")]
    bad = F.coalesce(F.col("model"), F.lit("")) == ""
    for c in counts:
        bad = bad | c.isNull() | (c < 0)
    bad = bad | (F.coalesce(F.col("event_signature"), F.lit("")) == "") | F.col("rollout_id").isNull()
    return bad | (F.col("cached_input_tokens") > F.col("input_tokens")) | (F.col("reasoning_output_tokens") > F.col("output_tokens"))


def invalid_rollout() -> Column:
    return (F.coalesce(F.col("rollout_id"), F.lit("")) == "") | (F.coalesce(F.col("conversation_id"), F.lit("")) == "") | ~F.col("thread_type").isin("main", "subagent", "unknown") | (F.col("last_activity_epoch_ms") < 0)


def invalid_source() -> Column:
    return (F.coalesce(F.col("file_path"), F.lit("")) == "") | (F.col("size_bytes") < 0) | (F.col("byte_offset") < 0) | (F.col("byte_offset") > F.col("size_bytes")) | ~F.col("canonical_status").isin("candidate", "canonical", "conflict")


def checked(df: DataFrame, bad: Column, what: str) -> DataFrame:
    """df; reading a row for which `bad` holds fails the query."""
    guard = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(f"invalid {what}"))).otherwise(F.lit(True))
    return df.where(guard)
