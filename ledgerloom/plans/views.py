"""The ledger's tables as views over the supplied `events` table, for Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_UUID = "concat(lower(lpad(hex({x}), 8, '0')), '-0000-7000-8000-000000000000')"
_TYPE = "CASE WHEN {u} % 5 = 0 THEN 'main' WHEN {u} % 5 = 4 THEN 'unknown' ELSE 'subagent' END"
EVENT_VIEW = {
    "token_event_ordinal": "event_id",
    "timestamp_epoch_ms": "{ms}",
    "rollout_id": "concat('r', CAST(user_id AS {string}))",
    "conversation_id": "concat('c', CAST(user_id % 20 AS {string}))",
    "model": "CASE event_id % 10 WHEN 0 THEN 'gpt-5.6-sol' WHEN 1 THEN 'gpt-5.6-terra' WHEN 2 THEN 'gpt-5.6-luna' WHEN 3 THEN 'gpt-5.5' WHEN 4 THEN 'gpt-5.4' "
    "WHEN 5 THEN 'gpt-5.4-mini' WHEN 6 THEN 'codex-auto-review' WHEN 7 THEN 'unknown' WHEN 8 THEN 'o3' ELSE 'gpt-5.6-preview' END",
    "thread_type": _TYPE.format(u="user_id"),
    "agent_role": "CASE event_type WHEN 'click' THEN 'worker' WHEN 'view' THEN 'reviewer' WHEN 'error' THEN 'unknown' WHEN 'signup' THEN 'explorer' ELSE 'scout' END",
    "agent_path": "concat('/root/', event_type)",
    "input_tokens": "CAST(floor(value * 10000) AS BIGINT)",
    "cached_input_tokens": "CAST(floor(value * 10000) AS BIGINT) * (event_id % 5) {div} 5",
    "output_tokens": "CAST(floor(value * 100) AS BIGINT)",
    "reasoning_output_tokens": "CAST(floor(value * 100) AS BIGINT) * (user_id % 4) {div} 4",
    "event_signature": "concat(CAST(event_id AS {string}), ':', event_type)",
}
ROLLOUT_VIEW = {
    "rollout_id": "concat('r', CAST(u AS {string}))",
    "conversation_id": "CASE WHEN u % 20 = 15 THEN 'legacy-15' ELSE " + _UUID.format(x="u % 20") + " END",
    "parent_thread_id": "CASE WHEN u % 5 = 0 THEN '' WHEN u % 3 = 0 THEN " + _UUID.format(x="(u - u % 5) % 20") + " ELSE concat('r', CAST((u - u % 2) {div} 2 AS {string})) END",
    "thread_type": _TYPE.format(u="u"),
    "is_realtime_voice": "(u % 35 = 0 AND u > 0)",
    "project_name": "concat('p', CAST(u % 7 AS {string}))",
    "thread_title": "''",
    "last_activity_epoch_ms": "la",
}
#: A source file for each rollout: what the scans of the ledger's tables need.
SOURCE_VIEW = {
    "file_path": "concat('/logs/rollout-', CAST(u AS {string}), '.jsonl')",
    "rollout_id": "concat('r', CAST(u AS {string}))",
    "size_bytes": "u * 1000 + 10",
    "modified_at_epoch_ms": "la",
    "byte_offset": "u * 1000",
    "canonical_status": "CASE u % 4 WHEN 3 THEN 'conflict' WHEN 2 THEN 'candidate' ELSE 'canonical' END",
    "is_present": "(u % 6 <> 5)",
    "last_scanned_at_epoch_ms": "la",
}
_SPARK = {"div": "DIV", "string": "STRING", "ms": "unix_millis(CAST(ts AS TIMESTAMP))"}
_DUCK = {"div": "//", "string": "VARCHAR", "ms": "epoch_us(ts) // 1000"}


def _items(view: dict[str, str], dialect: dict[str, str]) -> list[str]:
    return [f"{text.format(**dialect)} AS {name}" for name, text in view.items()]


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).selectExpr(*_items(EVENT_VIEW, _SPARK))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).selectExpr("user_id AS u", f"{_SPARK['ms']} AS ms").groupBy("u").agg({"ms": "max"}).withColumnRenamed("max(ms)", "la")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir).selectExpr(*_items(ROLLOUT_VIEW, _SPARK))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir).selectExpr(*_items(SOURCE_VIEW, _SPARK))


def sql_views() -> str:
    """`usage_events`, `rollouts` and `source_files` as the head of a DuckDB WITH clause."""
    users = f"(SELECT user_id AS u, max({_DUCK['ms']}) AS la FROM events GROUP BY user_id) q"
    part = lambda view, source: f"SELECT {', '.join(_items(view, _DUCK))} FROM {source}"
    return f"usage_events AS ({part(EVENT_VIEW, 'events')}), rollouts AS ({part(ROLLOUT_VIEW, users)}), source_files AS ({part(SOURCE_VIEW, users)})"
