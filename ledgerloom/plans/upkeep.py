"""Queries of the ledger's upkeep: reading logs, deciding on copies, mutations, diagnostics; each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions import presentation, text
from ledgerloom.operators import attribution, canonical, copies, mutations, resume
from ledgerloom.sources import logs, records
from ledgerloom.sources.staging import cut, drop_at_exit, shared_folder
from ledgerloom.streaming import collector

from . import views
from .catalogue import _PARSED, _STORED, WITH, _event_lines, _full_rollouts, _iso, _logs, _parse, _parsed_sql, _record, _users_number, query

_U = "CAST(substr(rollout_id, 2) AS BIGINT)"


# --- logs -----------------------------------------------------------------------------------------------------------------


def _log_files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """logs.FILES of session logs made of the events, a file each, written to the shared folder."""
    first = _record("session_meta", _iso(F.col("lo")), id=F.col("rollout_id"), session_id=F.lit("s"), cwd=F.lit("/w/p"))
    lines = _logs(spark, sf_dir, first, _event_lines())
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    lines.select("path", "line", F.col("raw").alias("value")).repartition("path").sortWithinPartitions("path", "line").select("path", "value").write.partitionBy("path").text(folder)
    drop_at_exit(spark, folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("modified_at_epoch_ms"))
    return cut(files, "files")  # each reading of the list goes over all files


def _rollout_of(path: Column) -> Column:
    return F.regexp_extract(path, r"rollout-2026-x-(r[0-9]+)\.jsonl", 1)


@query(f"{WITH} SELECT rollout_id, 3 * count(*) + 1 AS records, 3 * count(*) AS last_line, true AS whole FROM usage_events GROUP BY rollout_id")
def split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs on disk, read once in ranges of 16 KiB: records with their line numbers, and whether all bytes are stable."""
    files = _log_files(spark, sf_dir, "split")
    scanned = logs.scan(files, 16 << 10)
    lines = logs.numbered(scanned).groupBy("path").agg(F.count("*").alias("records"), F.max("line").alias("last_line"))
    whole = logs.facts(scanned, files).select("path", ((F.col("stable_length") == F.col("size_bytes")) & F.col("error").isNull()).alias("whole"))
    return lines.join(whole, "path").select(_rollout_of(F.col("path")).alias("rollout_id"), "records", "last_line", "whole")


_BIG = (
    ("session_meta", None), ("turn_context", None), ("compacted", None), ("response_item", "message"), ("response_item", "agent_message"), ("event_msg", "token_count"),
    ("event_msg", "mcp_tool_call_end"), ("event_msg", "agent_reasoning"), ("other", "message"), ("response_item", None),
)
_BIG_CLASS = ("critical", "critical", "opaque", "opaque", "critical", "critical", "opaque", "unclassified", "unclassified", "unclassified")


@query(f"SELECT event_id, CASE event_id % 10 {' '.join(f'WHEN {i} THEN {chr(39)}oversized_{c}{chr(39)}' for i, c in enumerate(_BIG_CLASS))} END AS class FROM events")
def oversize_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ten kinds as they are classified when they are too long."""
    kind = (F.col("event_id") % 10).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(x[i]).cast("string") for x in _BIG]), kind)
    raw = F.to_json(F.struct(pick(0).alias("type"), F.struct(pick(1).alias("type"), F.repeat(F.lit("x"), 50).alias("text")).alias("payload")))
    rows = views.raw_events(spark, sf_dir).select(F.lit("/log").alias("path"), F.col("event_id").alias("line"), raw.alias("raw"))
    return records.oversize_classes(rows).select(F.col("line").alias("event_id"), "class")


def _open_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs whose events start turns without a model: every third turn gets its model stated later, at the end of its line's
    event; the others stay open."""
    task, context, counted = _event_lines()
    late = F.col("token_event_ordinal") % 3 == 0
    first = _record("session_meta", _iso(F.col("lo")), id=F.col("rollout_id"))
    # both records have the fields of a context: those of a note are null, and to_json leaves them out
    either = F.when(late, context).otherwise(F.struct(context["timestamp"].alias("timestamp"), F.lit("note").alias("type"), F.lit(None).cast("struct<turn_id:string,model:string>").alias("payload")))
    return _logs(spark, sf_dir, first, [task, counted, either])


@query(f"{WITH} SELECT rollout_id, count(*) AS open_turns FROM usage_events WHERE (input_tokens > 0 OR output_tokens > 0) AND (token_event_ordinal % 3 <> 0 OR model = 'unknown') GROUP BY rollout_id")
def open_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose model no record has stated, of each log."""
    turns = _parse(_open_lines(spark, sf_dir))["turns"].where("unresolved")
    return turns.groupBy(_rollout_of(F.col("path")).alias("rollout_id")).agg(F.count("*").alias("open_turns"))


@query(f"{WITH} SELECT model, count(*) AS events FROM (SELECT CASE WHEN token_event_ordinal % 3 = 0 THEN model ELSE 'unknown' END AS model FROM usage_events WHERE input_tokens > 0 OR output_tokens > 0) GROUP BY model")
def late_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that are stated after the counts of their turn reach these."""
    return _parse(_open_lines(spark, sf_dir))["events"].groupBy("model").agg(F.count("*").alias("events"))


@query(_parsed_sql("true"))
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of each log is read as a whole, the second goes on from the state that it left."""
    first = _record("session_meta", _iso(F.col("lo")), id=F.col("rollout_id"))
    rows = cut(records.typed(_logs(spark, sf_dir, first, _event_lines())), "records")
    half = rows.groupBy("path").agg((F.floor(F.max("line") / 6) * 3).alias("half"))
    marked = cut(rows.join(half, "path"), "appended-logs")
    before = attribution.parse(marked.where("line <= half").select(*rows.columns), lambda lines: cut(lines, "lines"), attribution.spread(marked))
    after = resume.resumed(marked.where("line > half").select(*rows.columns), before["states"]).where("token_event_ordinal is not null")
    columns = _PARSED[1:]
    events = before["events"].select("path", *columns).unionByName(after.select("path", *columns))
    return events.select(_rollout_of(F.col("path")).alias("rollout_id"), *columns)


@query(f"{WITH} SELECT rollout_id, max(timestamp_epoch_ms) AS last_activity_epoch_ms FROM usage_events GROUP BY rollout_id")
def last_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _record("session_meta", _iso(F.col("lo")), id=F.col("rollout_id"))
    rows = records.typed(_logs(spark, sf_dir, first, _event_lines()[:1]))
    return records.metadata(rows).select("rollout_id", "last_activity_epoch_ms")


@query(
    f"{WITH}, e AS (SELECT rollout_id, token_event_ordinal AS line, CASE agent_role WHEN 'explorer' THEN false WHEN 'scout' THEN true END AS flag, CASE WHEN agent_role = 'explorer' THEN token_event_ordinal END AS turn FROM usage_events), "
    "t AS (SELECT rollout_id, line, CASE WHEN flag AND last_value(turn IGNORE NULLS) OVER w IS NULL THEN NULL ELSE flag END AS flag FROM e WINDOW w AS (PARTITION BY rollout_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    "SELECT rollout_id, line, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY rollout_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS overridden FROM t"
)
def turn_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a setting overrides the turn's model: settings do within a turn, a new turn ends it."""
    turn, setting = F.col("agent_role") == "explorer", F.col("agent_role") == "scout"
    lines = views.usage_events(spark, sf_dir).select(
        "rollout_id", F.col("rollout_id").alias("path"), F.col("token_event_ordinal").alias("line"), F.lit(True).alias("open"), F.lit(None).cast("string").alias("confirmed_turn"),
        F.when(turn, "turn_context").when(setting, "thread_settings_applied").otherwise("token_count").alias("kind"),
        F.when(turn, F.concat(F.lit("t"), F.col("token_event_ordinal").cast("string"))).alias("turn_id"), F.when(setting, F.col("model")).alias("settings_model"),
    )
    return attribution.with_turns(lines).select("rollout_id", "line", "overridden")


# --- copies of a session --------------------------------------------------------------------------------------------------


def _rows(df: DataFrame, kind: str, **given: Column) -> DataFrame:
    """copies.FOLD rows with the given columns."""
    blank = {f.split()[0]: F.lit(None).cast(f.split(" ", 1)[1]) for f in collector._fields(copies.FOLD)} | {"rewritten": F.lit(False), "sure": F.lit(True), "expected": F.lit(True), "legacy": F.lit(False), "target_free": F.lit(False)}
    attrs = F.struct(*[(F.lit(False) if a == "is_realtime_voice" else F.lit("x")).alias(a) for a in canonical.ATTRIBUTES])
    own = {"kind": F.lit(kind), "rollout_id": F.col("rollout_id"), "attrs": attrs, "activity": F.lit(0).cast("long"), "size_bytes": F.lit(1).cast("long"), "modified_at_epoch_ms": F.lit(1).cast("long"), "boundary_hash": F.lit("h")}
    return df.select(*[{**own, **given}.get(c, v).cast(v_type).alias(c) for (c, v), v_type in zip(blank.items(), [f.split(" ", 1)[1] for f in collector._fields(copies.FOLD)] + ["boolean"], strict=True)])


def _with_prints(stored: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rollout_id, n, prints) of stored events, and (rollout_id, path, n, prints) of the files' events."""
    n_stored, n_files = stored.groupBy("rollout_id").agg(F.count("*").alias("n")), files.groupBy("rollout_id", "path").agg(F.count("*").alias("n"))
    lengths = n_stored.unionByName(n_files.select("rollout_id", "n")).distinct()
    of_files = n_files.select("path", "rollout_id").join(lengths, "rollout_id").select("path", "n")
    return n_stored.join(copies.prints(stored, "rollout_id", lengths), "rollout_id", "left"), n_files.join(copies.prints(files, "path", of_files), "path", "left")


_PLACED = f"{WITH}, e AS (SELECT rollout_id, {_U} AS u, row_number() OVER (PARTITION BY rollout_id ORDER BY token_event_ordinal) AS k, count(*) OVER (PARTITION BY rollout_id) AS c FROM usage_events)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = Window.partitionBy("rollout_id")
    events = views.usage_events(spark, sf_dir).withColumn("k", F.row_number().over(span.orderBy("token_event_ordinal"))).withColumn("c", F.count("*").over(span))
    return events.withColumn("u", _users_number())


@query(
    f"{_PLACED}, o AS (SELECT rollout_id, u, count(*) FILTER (WHERE NOT (u % 5 = 2 AND k = c)) AS a, count(*) FILTER (WHERE NOT (u % 5 = 1 AND k = c)) AS b, max(c) AS c FROM e GROUP BY rollout_id, u), "
    "r AS (SELECT rollout_id, u, CASE WHEN u % 7 = 3 AND least(a, b) >= 1 THEN 'diverged' WHEN a = b THEN 'equal' WHEN b > a THEN 'extension' ELSE 'shorter' END AS relation FROM o WHERE b > 0) "
    "SELECT rollout_id, CASE WHEN u % 3 = 0 AND relation IN ('equal', 'extension') THEN 'recover' WHEN relation = 'diverged' THEN 'conflict' WHEN relation = 'shorter' THEN 'candidate' WHEN relation = 'extension' OR u % 11 = 4 THEN 'promote' ELSE 'candidate' END AS decision FROM r"
)
def copies_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of each session that lacks, continues or contradicts its events; the canonical file of every third is in
    conflict, of every eleventh gone."""
    events = _placed(spark, sf_dir)
    stored = events.where("not (u % 5 = 2 and k = c)")
    files = events.where("not (u % 5 = 1 and k = c)").withColumn("path", F.concat(F.lit("/b/"), F.col("rollout_id"))).withColumn("input_tokens", F.col("input_tokens") + F.when((F.col("u") % 7 == 3) & (F.col("k") == 1), 1).otherwise(0))
    held, read = _with_prints(stored, files)
    a, u = F.concat(F.lit("/a/"), F.col("rollout_id")), _users_number()
    ids = events.select("rollout_id").distinct().join(held, "rollout_id", "left")
    rows = _rows(ids, "stored", path=a, n=F.coalesce("n", F.lit(0)), prints=F.col("prints"))
    rows = rows.unionByName(_rows(ids, "source", path=a, status=F.when(u % 3 == 0, "conflict").otherwise("canonical"), present=u % 11 != 4))
    rows = rows.unionByName(_rows(read, "copy", path=F.col("path"), n=F.col("n"), prints=F.col("prints"), stable_length=F.col("n")))
    return copies.fold(rows).where("path like '/b/%'").select("rollout_id", "decision")


@query(
    f"{_PLACED}, o AS (SELECT DISTINCT rollout_id, u, c FROM e WHERE c > 3), f AS (SELECT o.*, i, c - i AS n, (u * 7 + i * 13) % 23 AS stable_length FROM o, range(4) r(i)), "
    "p AS (SELECT rollout_id, i, row_number() OVER (PARTITION BY rollout_id ORDER BY n > c - 2 DESC, stable_length DESC, i) AS place FROM f WHERE n >= c - 2) SELECT rollout_id, concat('/', CAST(i AS VARCHAR), '/', rollout_id) AS path FROM p WHERE place = 1"
)
def conflict_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose canonical file has damaged records, and four copies each: the file that takes its place."""
    events = _placed(spark, sf_dir).where("c > 3")
    files = events.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(4)]))).where("k <= c - i")
    files = files.withColumn("path", F.concat(F.lit("/"), F.col("i").cast("string"), F.lit("/"), F.col("rollout_id")))
    held, read = _with_prints(events.where("k <= c - 2"), files)
    i = F.substring("path", 2, 1).cast("int")
    a = F.concat(F.lit("/a/"), F.col("rollout_id"))
    rows = _rows(held, "stored", path=a, n=F.col("n"), prints=F.col("prints")).unionByName(_rows(held, "source", path=a, status=F.lit("canonical"), present=F.lit(True)))
    rows = rows.unionByName(_rows(held, "broken", path=a, n=F.lit(0)))
    rows = rows.unionByName(_rows(read, "seed", path=F.col("path"), n=F.col("n"), prints=F.col("prints"), stable_length=(_users_number() * 7 + i * 13) % 23))
    return copies.fold(rows).where("taken").select("rollout_id", "path")


@query(f"{WITH}, s AS (SELECT *, {_U} AS u FROM source_files) SELECT file_path FROM s WHERE u % 7 <> 5 AND (u % 5 = 2 OR canonical_status = 'conflict' OR NOT is_present OR u % 9 = 4)")
def read_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that an inventory reads: larger than known, in conflict, back again, or copies whose canonical file is gone."""
    sources = views.sources(spark, sf_dir)
    u = _users_number()
    found = sources.where(u % 7 != 5).select("file_path", (F.col("size_bytes") + F.when(u % 5 == 2, 1).otherwise(0)).alias("size_bytes"), "modified_at_epoch_ms")
    rollouts = sources.select("rollout_id", F.when(u % 9 == 4, "/gone").otherwise(F.when(u % 7 != 5, F.col("file_path"))).alias("canonical_source_path"))
    return collector.changed_files(found, sources, rollouts).select("file_path")


# --- mutations ------------------------------------------------------------------------------------------------------------

_NO_CHECKPOINTS = "file_path string, rollout_id string"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = {"prefix_hash": F.lit("h"), "prefix_status": F.lit("verified"), "last_error": F.lit(None).cast("string")}
    return views.sources(spark, sf_dir).withColumns(extra).select(*schema.struct(schema.SOURCES).fieldNames())


@query(f"{WITH}, s AS (SELECT *, {_U} AS u FROM source_files) SELECT file_path, CASE WHEN u % 3 = 0 THEN 'candidate' ELSE canonical_status END AS canonical_status, u % 3 <> 0 OR u % 2 = 0 AS has_checkpoint FROM s WHERE u % 3 = 0 OR u % 2 = 0")
def source_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second source is known, every third is scanned again and is no canonical one now: those lose checkpoints."""
    sources, u = _sources(spark, sf_dir), _users_number()
    old, new = sources.where(u % 2 == 0), sources.where(u % 3 == 0).withColumn("canonical_status", F.lit("candidate"))
    table, left = mutations.upsert_sources(old, new, sources.where((u % 2 == 0) & (u % 3 != 0) | (u % 6 == 3)).select("file_path", "rollout_id"))
    kept = left.select("file_path", F.lit(True).alias("_kept"))
    return table.join(kept, "file_path", "left").select("file_path", "canonical_status", (F.coalesce("_kept", F.lit(False)) | (F.substring("rollout_id", 2, 20).cast("long") % 6 == 0)).alias("has_checkpoint"))


@query(f"{WITH} SELECT CASE WHEN rollout_id = 'r4' THEN '00000004-0000-7000-8000-000000000000' ELSE rollout_id END AS rollout_id, count(*) AS events FROM usage_events GROUP BY 1")
def rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A legacy id renamed in all tables: the events of each id."""
    tables = {"rollouts": _full_rollouts(spark, sf_dir), "usage_events": views.usage_events(spark, sf_dir).select(*_STORED), "source_files": _sources(spark, sf_dir), "rollout_checkpoints": spark.createDataFrame([], _NO_CHECKPOINTS)}
    return mutations.rekey(tables, "r4", "00000004-0000-7000-8000-000000000000")["usage_events"].groupBy("rollout_id").agg(F.count("*").alias("events"))


@query(f"{WITH}, s AS (SELECT *, {_U} % 4 = 1 AS hit FROM source_files) SELECT file_path, CASE WHEN hit THEN 'conflict' ELSE canonical_status END AS canonical_status, CASE WHEN hit THEN 'differs' END AS last_error, CAST(CASE WHEN hit THEN 1 ELSE 0 END AS BIGINT) AS reports FROM s")
def conflicts_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _sources(spark, sf_dir)
    found = sources.where(_users_number() % 4 == 1).select("file_path", F.lit("differs").alias("message"))
    after, _, told = mutations.record_conflicts(sources, spark.createDataFrame([], _NO_CHECKPOINTS), spark.createDataFrame([], schema.DIAGNOSTICS), found, 7)
    told = told.groupBy("file_path").agg(F.count("*").alias("reports"))
    return after.join(told, "file_path", "left").select("file_path", "canonical_status", "last_error", F.coalesce("reports", F.lit(0)).alias("reports"))


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report a minute of each user's event type."""
    minute = F.expr("unix_millis(CAST(ts AS TIMESTAMP))")
    return views.raw_events(spark, sf_dir).select(F.concat(F.lit("/f"), F.col("user_id").cast("string")).alias("file_path"), F.col("event_type").alias("message"), F.lit("source_conflict").alias("code"), minute.alias("created_at_epoch_ms"))


@query("SELECT max(n) AS most FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)")
def repeated_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.repeated_diagnostics(_diagnostics(spark, sf_dir), "source_conflict")


@query("WITH m AS (SELECT max(epoch_us(ts) // 1000) AS last FROM events), k AS (SELECT DISTINCT user_id, event_type FROM events, m WHERE epoch_us(ts) // 1000 > last - 300000), a AS (SELECT DISTINCT user_id, event_type FROM events) SELECT concat('/f', CAST(user_id AS VARCHAR)) AS file_path, event_type AS message FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = a.user_id AND k.event_type = a.event_type)")
def reports_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conflicts met again just now: those that were told within five minutes are not told again."""
    known = _diagnostics(spark, sf_dir)
    now = known.agg(F.max("created_at_epoch_ms")).head()[0]
    new = known.select("file_path", F.lit("source-diverged").alias("reason"), "message").distinct()
    return collector.reports(new, known, now).select("file_path", "message")


@query("WITH r AS (SELECT user_id, min(epoch_us(ts) // 1000) AS a FROM events GROUP BY user_id) SELECT concat('run', lpad(CAST(user_id AS VARCHAR), 9, '0')) AS run_id, CASE WHEN user_id = 4 THEN 'completed' WHEN user_id % 2 = 0 THEN 'running' ELSE 'failed' END AS status, CASE WHEN user_id = 4 THEN 99 END AS completed_at_epoch_ms, CASE WHEN user_id = 4 THEN 98 END AS heartbeat_at_epoch_ms FROM r")
def runs_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a user; one that runs gives a last sign and ends."""
    runs = mutations.finish_run(mutations.heartbeat(_runs(spark, sf_dir), "run000000004", 98), "run000000004", 99, "completed")
    return runs.select("run_id", "status", "completed_at_epoch_ms", "heartbeat_at_epoch_ms")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = views.raw_events(spark, sf_dir).groupBy("user_id").agg(F.min(F.expr("unix_millis(CAST(ts AS TIMESTAMP))")).alias("started_at_epoch_ms"))
    none = F.lit(None)
    return first.select(F.concat(F.lit("run"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("run_id"), F.when(F.col("user_id") % 2 == 0, "running").otherwise("failed").alias("status"), "started_at_epoch_ms", none.cast("long").alias("completed_at_epoch_ms"), none.cast("long").alias("heartbeat_at_epoch_ms"), none.cast("string").alias("error"))


@query("SELECT concat('run', lpad(CAST(user_id AS VARCHAR), 9, '0')) AS run_id FROM (SELECT user_id, min(epoch_us(ts)) // 1000 AS a FROM events GROUP BY user_id) ORDER BY a DESC, run_id DESC LIMIT 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.latest_run(_runs(spark, sf_dir)).select("run_id")


@query("SELECT concat('k', CAST(user_id AS VARCHAR)) AS key, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE 'old' END AS value FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 2 = 0 OR user_id % 3 = 0")
def state_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = views.raw_events(spark, sf_dir).select("user_id", F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key")).distinct()
    row = lambda where, value: keys.where(where).select("key", F.lit(value).alias("value"), F.lit(1).cast("long").alias("updated_at_epoch_ms"))
    return mutations.put_state(row("user_id % 3 = 0", "old"), row("user_id % 2 = 0", "new")).select("key", "value")


@query(f"{WITH} SELECT token_event_ordinal % 5 AS kind, count(*) AS events, CAST(sum(CASE WHEN (token_event_ordinal % 5 = 1 AND input_tokens - 1 < cached_input_tokens) OR token_event_ordinal % 5 IN (2, 3) OR (token_event_ordinal % 5 = 4 AND output_tokens < reasoning_output_tokens + 1) THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM usage_events GROUP BY 1")
def invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events spoilt in five ways, and how many the ledger would refuse."""
    k = F.col("token_event_ordinal") % 5
    bad = views.usage_events(spark, sf_dir).withColumn("kind", k).withColumns({"cached_input_tokens": F.when(k == 1, F.col("cached_input_tokens") + 1).otherwise(F.col("cached_input_tokens")), "model": F.when(k == 2, "").otherwise(F.col("model")), "event_signature": F.when(k == 3, F.lit(None)).otherwise(F.col("event_signature")), "reasoning_output_tokens": F.when(k == 4, F.col("reasoning_output_tokens") + 1).otherwise(F.col("reasoning_output_tokens"))})
    return bad.groupBy("kind").agg(F.count("*").alias("events"), F.count_if(schema.invalid_event()).alias("invalid"))


# --- texts ----------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('0190', lower(lpad(hex(event_id), 4, '0')), '-abcd-7000-8000-000000000000') END AS typed FROM events")
def typed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as users type them: in upper case with blanks, with another version, cut short."""
    id_ = F.concat(F.lit("0190"), F.lpad(F.hex("event_id"), 4, "0"), F.lit("-ABCD-"), F.when(F.col("event_id") % 3 == 1, "4").otherwise("7"), F.lit("000-8000-00000000000"))
    typed = F.concat(F.lit("  "), id_, F.when(F.col("event_id") % 3 == 2, "").otherwise("0"), F.lit(" "))
    return views.raw_events(spark, sf_dir).select("event_id", text.normalized_id(typed).alias("typed"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'observing' WHEN 1 THEN concat(strftime(CAST(epoch_ms(epoch_us(ts) // 1000 + 28800000) AS TIMESTAMP), '%H:%M:%S'), ' - ', strftime(CAST(epoch_ms(epoch_us(ts) // 1000 + 28860000) AS TIMESTAMP), '%H:%M:%S'), ' not observed') WHEN 2 THEN 'observation gap' ELSE 'baseline of this run' END AS coverage FROM events")
def coverage_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, ms = F.col("event_id") % 4, F.expr("unix_millis(CAST(ts AS TIMESTAMP))")
    coverage = F.when(kind == 0, "continuous").when(kind <= 2, "gap").otherwise("new")
    return views.raw_events(spark, sf_dir).select("event_id", presentation.coverage_text(coverage, F.when(kind == 1, ms), ms + 60_000).alias("coverage"))
