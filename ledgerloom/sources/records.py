"""From log files to typed records: stable lines, strict JSON, record classes, file-level rejection."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions.text import fallback_rollout_id, is_uuid_v7, project_name, timestamp_epoch_ms

#: Longer records are classified but never taken in; deepest JSON nesting; largest accepted integer.
MOST_RECORD_BYTES, MOST_DEPTH, MOST_INTEGER = 1 << 20, 64, 2**53 - 1
#: Bytes before the end of the stable content that identify it.
BOUNDARY_BYTES = 64 << 10
# Payload types of oversized records that may be skipped, and of those that carry context.
OPAQUE_ITEMS = (
    "custom_tool_call", "custom_tool_call_output", "function_call", "function_call_output", "local_shell_call", "message", "reasoning",
    "tool_search_call", "tool_search_output", "web_search_call", "image_generation_call", "compaction", "compaction_summary", "context_compaction",
)
OPAQUE_EVENTS = ("image_generation_end", "mcp_tool_call_end")
CRITICAL_EVENTS = ("token_count", "thread_settings_applied", "task_started", "task_complete")
CRITICAL_TYPES = ("session_meta", "turn_context", "inter_agent_communication_metadata")


def inventory(spark: SparkSession, *roots: str) -> DataFrame:
    """file_path, size_bytes, modified_at of all log files below the roots; contents are not read."""
    from .logs import listing

    files, _ = listing(spark, *roots)
    return files.select("file_path", "size_bytes", F.timestamp_millis("modified_at_epoch_ms").alias("modified_at"))


def contents(spark: SparkSession, *roots: str) -> DataFrame:
    """path, content of all log files below the roots."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "rollout-*.[jJ][sS][oO][nN][lL]").load(list(roots))
    return files.select("path", "content", F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("modified_at_epoch_ms"))


def snapshots(files: DataFrame) -> DataFrame:
    """path, stable length (up to the last line feed), hash of the content and of the boundary before the stable end."""
    stable = files.withColumn("stable_length", F.length("content") - F.coalesce(F.length(F.substring_index(F.decode("content", "ISO-8859-1"), "\n", -1)), F.lit(0)))
    start = F.greatest(F.col("stable_length") - BOUNDARY_BYTES, F.lit(0))
    boundary = F.col("content").substr(start + 1, F.col("stable_length") - start)
    return stable.select("path", "size_bytes", "modified_at_epoch_ms", "stable_length", F.sha2("content", 256).alias("content_hash"), F.sha2(boundary, 256).alias("boundary_hash"))


def confirmed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Snapshots whose content was the same at a second reading."""
    return first.join(second.select("path", F.col("content_hash").alias("again")), "path").where("content_hash = again").drop("again")


# --- one record -----------------------------------------------------------------------------------------------------


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _too_deep(value: object, left: int = MOST_DEPTH) -> bool:
    if not isinstance(value, dict | list):
        return False
    return left <= 0 or any(_too_deep(v, left - 1) for v in (value.values() if isinstance(value, dict) else value))


def _text(value: dict, name: str) -> str | None:
    return x if isinstance(x := value.get(name), str) and x else None


def _object(value: dict, *names: str) -> dict:
    for name in names:
        value = value.get(name) if isinstance(value, dict) else None
    return value if isinstance(value, dict) else {}


def _integer(value: dict, name: str) -> int | None:
    return x if type(x := value.get(name)) is int and 0 <= x <= MOST_INTEGER else None


def _tuple(value: object) -> dict | None:
    if not isinstance(value, dict):
        return None
    out = {short: _integer(value, name) for short, name in (("input", "input_tokens"), ("cached", "cached_input_tokens"), ("output", "output_tokens"), ("reasoning", "reasoning_output_tokens"), ("total", "total_tokens"))}
    return None if None in out.values() else out


def classified(raw: bytes) -> tuple[str, dict]:
    """Class of one record and the object, if it is one."""
    if raw and not raw.strip(b"\0"):
        return "null_padding", {}
    if len(raw) > MOST_RECORD_BYTES:
        return _oversized(raw), {}
    if not raw.strip(b" \t\r\n") or (raw[:1] >= b"\x80" and not raw.decode("utf-8", "replace").strip()):
        return "blank", {}
    try:
        value = json.loads(raw.decode("utf-8"), parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return "malformed", {}
    if raw.count(b"{") + raw.count(b"[") > MOST_DEPTH and _too_deep(value):
        return "malformed", {}
    return ("object", value) if isinstance(value, dict) else ("non_object", {})


def _oversized(raw: bytes) -> str:
    """Class of a record that is too long: what it may be is told by its type and payload type alone, each stated once."""
    def pairs(items: list[tuple[str, object]]) -> dict:
        out = dict(items)
        if sum(name in ("type", "payload") for name, _ in items) > len({"type", "payload"} & out.keys()):
            out["\0repeated"] = True
        return out

    try:
        root = json.loads(raw.decode("utf-8"), parse_constant=_no_constant, object_pairs_hook=pairs)
    except (ValueError, RecursionError):
        return "malformed"
    if not isinstance(root, dict) or root.get("\0repeated"):
        return "oversized_unclassified"
    kind, payload = root.get("type"), root.get("payload")
    if "payload" in root and not isinstance(payload, dict):
        return "oversized_unclassified"
    if kind in CRITICAL_TYPES:
        return "oversized_critical"
    if kind == "compacted":
        return "oversized_opaque"
    if not isinstance(payload, dict) or payload.get("\0repeated"):
        return "oversized_unclassified"
    inner = payload.get("type")
    if (kind, inner) == ("response_item", "agent_message") or (kind == "event_msg" and inner in CRITICAL_EVENTS):
        return "oversized_critical"
    opaque = (kind == "response_item" and inner in OPAQUE_ITEMS) or (kind == "event_msg" and inner in OPAQUE_EVENTS)
    return "oversized_opaque" if opaque else "oversized_unclassified"


def oversize_classes(lines: DataFrame) -> DataFrame:
    """(path, line, raw) with the class that each record has when it is too long to be taken in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_oversized(raw) for raw in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("line"), pa.array(found, pa.string())], names=["path", "line", "class"])

    return lines.select("path", F.col("line").cast("long").alias("line"), F.col("raw").cast("binary").alias("raw")).mapInArrow(run, "path string, line long, class string")


def flat(path: str, line: int, raw: bytes) -> dict:
    """One record as a row of schema.RECORDS."""
    kind, root = classified(raw)
    payload = root.get("payload") if isinstance(root.get("payload"), dict) else None
    row = dict.fromkeys(_FIELDS) | {"path": path, "line": line, "class": kind, "type": _text(root, "type"), "ts": _text(root, "timestamp"), "has_payload": payload is not None}
    if payload is None:
        return row
    row |= {
        "payload_type": _text(payload, "type"), "turn_id": _text(payload, "turn_id"), "model": _text(payload, "model"),
        "settings_model": _text(_object(payload, "thread_settings"), "model"), "started_at": _integer(payload, "started_at"),
        "trigger": payload.get("trigger_turn") is True, "recipient": _text(payload, "recipient"),
        "internal_turn_id": _text(_object(payload, "internal_chat_message_metadata_passthrough"), "turn_id"),
        "usage": _tuple(_object(payload, "info").get("last_token_usage")), "total": _tuple(_object(payload, "info").get("total_token_usage")),
    }
    if row["type"] == "session_meta":
        inner = _object(payload, "source", "subagent").get("thread_spawn")
        spawn = inner if isinstance(inner, dict) else {}
        row["meta"] = {n: _text(payload, n) for n in ("session_id", "id", "thread_source", "cwd", "forked_from_id")} | {"has_spawn": isinstance(inner, dict)}
        row["meta"] |= {n: _text(spawn, n) or _text(payload, n) for n in ("parent_thread_id", "agent_role", "agent_path", "agent_nickname")}
    return row


_FIELDS = schema.RECORDS.fieldNames()


def records(files: DataFrame) -> DataFrame:
    """Typed records of files (path, content): one row for each stable line, numbered from 0. What follows the last
    line feed is not stable and left out."""
    arrow = _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                lines = content.as_py().split(b"\n")[:-1]
                for at in range(0, len(lines), 4_096):
                    rows = [flat(path, at + i, raw.removesuffix(b"\r")) for i, raw in enumerate(lines[at : at + 4_096])]
                    yield _batch(rows, arrow)

    return files.select("path", "content").mapInArrow(run, schema.RECORDS)


def typed(lines: DataFrame) -> DataFrame:
    """Typed records of lines (path, line, raw) that are split and numbered already: a log may spread over tasks."""
    arrow = _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("path", "line", "raw"))
            yield _batch([flat(path, line, raw) for path, line, raw in zip(*columns, strict=True)], arrow)

    return lines.select("path", F.col("line").cast("long").alias("line"), F.col("raw").cast("binary").alias("raw")).mapInArrow(run, schema.RECORDS)


def _batch(rows: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    """What RecordBatch.from_pylist gives; structs are built by their fields, which takes half the time."""

    def column(values: list, kind: pa.DataType) -> pa.Array:
        if values.count(None) == len(values):
            return pa.nulls(len(values), kind)
        if not pa.types.is_struct(kind):
            return pa.array(values, kind)
        parts = [column([None if v is None else v.get(f.name) for v in values], f.type) for f in kind]
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=pa.array([v is None for v in values]))

    return pa.RecordBatch.from_arrays([column([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)


def _arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema.RECORDS)


def damaged_files(rows: DataFrame) -> DataFrame:
    """path of every file with a record that is neither parsed nor harmless: none of its records count."""
    return rows.groupBy("path").agg(F.max((~F.col("class").isin(schema.OBJECT, *schema.HARMLESS)).cast("int")).alias("bad")).where("bad = 1").select("path")


def class_counts(rows: DataFrame) -> DataFrame:
    """Number of records of each class in each file."""
    return rows.groupBy("path").pivot("class", ["blank", "null_padding", "malformed", "non_object", "object", "oversized_opaque", "oversized_critical", "oversized_unclassified"]).count().na.fill(0)


def metadata(rows: DataFrame) -> DataFrame:
    """One row for each file: the rollout's attributes by its first session_meta, and its last activity."""
    first = Window.partitionBy("path").orderBy("line")
    is_meta = (F.col("type") == "session_meta") & F.col("has_payload")
    metas = rows.where(is_meta).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("path", F.col("line").alias("meta_line"), "meta", F.col("ts").alias("meta_ts"))
    ms = F.max(F.when(F.col("class") == schema.OBJECT, timestamp_epoch_ms(F.col("ts"))))
    files = rows.groupBy("path").agg(F.greatest(F.coalesce(ms, F.lit(0)), F.lit(0)).alias("last_activity_epoch_ms")).join(metas, "path", "left")
    m = lambda n: F.col(f"meta.{n}")
    spawned = F.coalesce(m("has_spawn"), F.lit(False))
    kind = F.when((m("thread_source") == "subagent") | spawned, "subagent").when(m("thread_source").isNull() | m("thread_source").isin("user", "realtime_voice"), "main").otherwise("unknown")
    rollout = F.coalesce(m("id"), fallback_rollout_id(F.col("path")))
    typed = files.withColumn("thread_type", kind)
    main = F.col("thread_type") == "main"
    return typed.select(
        "path", "meta_line", "meta_ts", F.coalesce(m("session_id"), rollout).alias("conversation_id"), rollout.alias("rollout_id"), F.coalesce(m("parent_thread_id"), F.lit("")).alias("parent_thread_id"), "thread_type",
        F.when(main, "main").otherwise(F.coalesce(m("agent_role"), F.lit("unknown"))).alias("agent_role"), F.when(main, "/root").otherwise(F.coalesce(m("agent_path"), F.lit("/root"))).alias("agent_path"),
        F.coalesce(m("agent_nickname"), F.lit("")).alias("agent_nickname"), F.coalesce(m("thread_source") == "realtime_voice", F.lit(False)).alias("is_realtime_voice"),
        project_name(m("cwd")).alias("project_name"), F.lit("").alias("thread_title"), "last_activity_epoch_ms", m("forked_from_id").isNotNull().alias("forked"),
    )


# --- the index of session titles --------------------------------------------------------------------------------------


#: A larger index of titles is not read.
MOST_INDEX_BYTES = 64 << 20


class UnstableIndex(Exception):
    """The index of titles is too large, or changed while it was read."""


def stable_titles(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """session_titles of an index that is the same before and after the reading, and the number of invalid records."""
    from .logs import facts_of_file
    from .staging import cut

    try:
        before = facts_of_file(path)
    except OSError:
        before = None
    if before is not None and before[0] > MOST_INDEX_BYTES:
        raise UnstableIndex(f"the index of titles has more than {MOST_INDEX_BYTES} bytes")
    titles, invalid = session_titles(spark, path)
    titles, bad = cut(titles, "titles"), invalid.head()[0]
    if before is not None and facts_of_file(path) != before:
        raise UnstableIndex("the index of titles changed while it was read")
    return titles, bad


def session_titles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(conversation_id, title) with the latest title of each conversation, of ties the later line; and the number of
    invalid records. Records over 1 MiB, without a version-7 id, a title or a timestamp are invalid; a missing index
    is empty."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "conversation_id string, title string"), spark.createDataFrame([(0,)], "invalid long")
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for line, raw in enumerate(content.as_py().split(b"\n")):
                    raw = raw.removeprefix(b"\xef\xbb\xbf") if line == 0 else raw
                    kind, root = classified(raw) if len(raw) <= MOST_RECORD_BYTES else ("malformed", {})
                    if kind != "blank":
                        rows.append({"line": line, "id": _text(root, "id"), "title": (_text(root, "thread_name") or "").strip() or None, "ts": _text(root, "updated_at")})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("line", pa.int64()), ("id", pa.string()), ("title", pa.string()), ("ts", pa.string())]))

    return latest_titles(files.mapInArrow(run, "line long, id string, title string, ts string"))


def latest_titles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What session_titles gives, of records (line, id, title, ts)."""
    rows = rows.withColumn("at", timestamp_epoch_ms(F.col("ts")))
    valid = is_uuid_v7(F.col("id")) & F.col("title").isNotNull() & F.col("at").isNotNull()
    titles = rows.where(valid).groupBy(F.lower("id").alias("conversation_id")).agg(F.max_by("title", F.struct("at", "line")).alias("title"))
    return titles, rows.agg(F.count_if(~valid).alias("invalid"))
