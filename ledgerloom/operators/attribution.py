"""From typed records to usage events: replay gates of forks, turns, model overrides, deduplication, late models.

Everything sequential is a window over the lines of a file: what was last set, what was last cleared, the first line
at which a gate opens. Windows are partitioned by file, so files are independent and spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerloom.functions.text import timestamp_epoch_ms, uuid_v7_epoch_ms
from ledgerloom.sources.records import metadata

from . import resume

MOST_TASKS = 10_000
EVENT_COLUMNS = (
    "path", "conversation_id", "rollout_id", "parent_thread_id", "thread_type", "agent_role", "agent_path", "agent_nickname", "timestamp", "timestamp_epoch_ms",
    "token_event_ordinal", "turn_id", "model", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "cumulative_snapshot", "event_signature",
)

def _lines() -> WindowSpec:
    return Window.partitionBy("path").orderBy("line")

def _so_far() -> WindowSpec:
    return _lines().rowsBetween(Window.unboundedPreceding, 0)

def _segment() -> WindowSpec:
    return Window.partitionBy("path", "_segment")

def _last(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(_so_far())

#: Lines of a task's windows, on average.
LINES_A_TASK = 1 << 18

def spread(rows: DataFrame) -> int:
    """Tasks for the windows over rows, which are a written table: their memory then does not grow with the table."""
    return min(max(rows.count() // LINES_A_TASK + 1, rows.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)

def _kinds(lines: DataFrame) -> DataFrame:
    kind = F.when(F.col("type") == "event_msg", F.col("payload_type")).otherwise(F.col("type"))
    return lines.withColumn("kind", F.when(F.col("has_payload"), kind))

def _gates(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """path, _opens, _turn, _model of forks: the line that opens a gate, and the turn that it confirms for a subagent."""
    forks = meta.where("forked and thread_type in ('main', 'subagent')").select("path", "meta_line", "meta_ts", "rollout_id", "thread_type", "agent_path")
    telling = F.col("kind").isin("task_started", "turn_context", "inter_agent_communication_metadata", "response_item")
    lines = _kinds(rows.where(F.col("class") == "object")).where(telling).join(forks, "path").where("line > meta_line")
    # main forks
    boundary = F.coalesce(timestamp_epoch_ms(F.col("meta_ts")), uuid_v7_epoch_ms(F.col("rollout_id")))
    turn_ms, seconds = uuid_v7_epoch_ms(F.col("turn_id")), F.floor(boundary / 1000)
    later = F.coalesce(turn_ms > boundary, F.lit(False))
    by_start = F.col("started_at") > seconds
    live = F.when(boundary.isNull(), False).when(F.col("started_at").isNull() | (F.col("started_at") == seconds), later).otherwise(by_start & (turn_ms.isNull() | (later == by_start)))
    main = lines.where((F.col("thread_type") == "main") & (F.col("kind") == "task_started") & live).groupBy("path").agg(F.min("line").alias("_opens"))
    # subagent forks: a segment begins with each task that names its turn
    starts = (F.col("kind") == "task_started") & F.col("turn_id").isNotNull()
    sub = lines.where("thread_type = 'subagent'").withColumn("_segment", F.count_if(F.coalesce(starts, F.lit(False))).over(_so_far()))
    sub = sub.withColumn("_turn", F.first(F.when(starts, F.col("turn_id")), ignorenulls=True).over(_segment()))
    context = F.when((F.col("kind") == "turn_context") & (F.col("turn_id") == F.col("_turn")), F.col("line"))
    sub = sub.withColumn("_context", F.min(context).over(_segment()))
    sub = sub.withColumn("_model", F.max(F.when(F.col("line") == F.col("_context"), F.col("model"))).over(_segment()))
    trigger = F.when((F.col("kind") == "inter_agent_communication_metadata") & F.col("trigger") & (F.col("line") > F.col("_context")), F.col("line"))
    sub = sub.withColumn("_trigger", F.min(trigger).over(_segment()))
    addressed = (F.col("recipient") == F.col("agent_path")) & (F.col("internal_turn_id").isNull() | (F.col("internal_turn_id") == F.col("_turn")))
    message = (F.col("kind") == "response_item") & (F.col("payload_type") == "agent_message") & addressed & (F.col("line") > F.col("_trigger"))
    confirmed = sub.where(message).groupBy("path").agg(F.min("line").alias("_opens"), F.min_by("_turn", "line").alias("_turn"), F.min_by("_model", "line").alias("_model"))
    none = F.lit(None).cast("string")
    return main.withColumns({"_turn": none, "_model": none}).unionByName(confirmed)

def gated(rows: DataFrame, meta: DataFrame, tasks: int | None = None) -> DataFrame:
    """The object records with their file's attributes and `open`: whether turn contexts, task starts and token counts
    on this line count. A fork repeats its parent's records after the session_meta; they do not count until the gate
    opens: for a main fork at the first task that provably started after the fork, for a subagent when a started task
    is confirmed by its context, a trigger and a message to the agent, in this order; for others never. Gates are a row
    a fork; every line meets its file's attributes in the one shuffle that the windows need (of so many tasks)."""
    lines = _kinds(rows.where(F.col("class") == "object"))
    lines = lines.repartition(tasks, "path") if tasks else lines
    lines = lines.join(meta.join(_gates(rows, meta), "path", "left").hint("shuffle_hash"), "path")
    lines = lines.withColumn("after_meta", F.coalesce(F.col("forked") & (F.col("line") > F.col("meta_line")), F.lit(False)))
    lines = lines.withColumn("open", ~F.col("after_meta") | F.coalesce(F.col("line") >= F.col("_opens"), F.lit(False)))
    confirmed = F.col("line") == F.col("_opens")
    return lines.withColumn("confirmed_turn", F.when(confirmed, F.col("_turn"))).withColumn("confirmed_model", F.when(confirmed, F.col("_model"))).drop("_turn", "_model", "_opens")

def with_turns(lines: DataFrame) -> DataFrame:
    """lines with current_turn, overridden and current_model as they stand at each line."""
    context = F.col("open") & (F.col("kind") == "turn_context") & F.col("turn_id").isNotNull()
    task = F.col("open") & (F.col("kind") == "task_started")
    sets = F.coalesce(F.col("confirmed_turn"), F.when(context | (task & F.col("turn_id").isNotNull()), F.col("turn_id")))
    lines = lines.withColumn("_set", sets).withColumn("_last_set", _last(F.col("_set")))
    done = (F.col("kind") == "task_complete") & (F.col("turn_id").isNull() | (F.col("turn_id") == F.col("_last_set")))
    lines = lines.withColumn("_done", F.coalesce(done, F.lit(False)))
    lines = lines.withColumn("current_turn", F.coalesce(_last(F.when(F.col("_done"), "").otherwise(F.col("_set"))), F.lit("")))
    before = F.coalesce(F.lag("current_turn").over(_lines()), F.lit(""))
    setting = (F.col("kind") == "thread_settings_applied") & F.col("settings_model").isNotNull()
    flag = F.when(F.coalesce(setting, F.lit(False)) & (F.col("current_turn") != ""), True).when(F.col("_done") | F.coalesce(task, F.lit(False)) | (F.coalesce(context, F.lit(False)) & (F.col("turn_id") != before)), False)
    lines = lines.withColumn("_flag", flag)
    lines = lines.withColumn("overridden", F.coalesce(_last(F.col("_flag")), F.lit(False))).withColumn("current_model", F.coalesce(_last(F.when(setting, F.col("settings_model"))), F.lit("unknown")))
    return lines.withColumnRenamed("_set", "last_set").drop("_last_set", "_done", "_flag")

def _stated() -> tuple[Column, Column]:
    """The turn and the model that a line states."""
    context = F.col("open") & (F.col("kind") == "turn_context") & F.col("turn_id").isNotNull() & F.col("model").isNotNull()
    return F.coalesce("confirmed_turn", F.when(context, F.col("turn_id"))), F.coalesce("confirmed_model", F.when(context, F.col("model")))

def _counted() -> Column:
    """Whether a line is an open token count."""
    return F.coalesce(F.col("open") & (F.col("kind") == "token_count") & ~F.col("is_realtime_voice"), F.lit(False))

def _judged(lines: DataFrame) -> DataFrame:
    """lines with drop_reason and cumulative_snapshot of the token counts among them."""
    u = F.col("usage")
    reason = (
        F.when(F.col("usage").isNull() | F.col("total").isNull(), "invalid_usage")
        .when((u["input"] == 0) & (u["cached"] == 0) & (u["output"] == 0) & (u["reasoning"] == 0), "zero_breakdown")
        .when((u["cached"] > u["input"]) | (u["reasoning"] > u["output"]), "invalid_relation")
        .when(timestamp_epoch_ms(F.col("ts")).isNull(), "invalid_timestamp")
    )
    lines = lines.withColumn("drop_reason", F.when(_counted(), reason))
    t = F.col("total")
    snapshot = F.concat_ws(":", t["input"], t["cached"], t["output"], t["reasoning"], t["total"])
    lines = lines.withColumn("cumulative_snapshot", F.when(_counted() & F.col("drop_reason").isNull(), snapshot))
    previous = F.last("cumulative_snapshot", ignorenulls=True).over(_lines().rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("drop_reason", F.when(F.col("cumulative_snapshot") == previous, "duplicate_snapshot").otherwise(F.col("drop_reason")))

def candidates(lines: DataFrame) -> DataFrame:
    """Open token counts with drop_reason: why a count gives no event, or null."""
    return _judged(lines.where(_counted()))

def attributed(lines: DataFrame) -> DataFrame:
    """Events of the kept counts: the active setting's model, else the one last stated for the turn over the whole file,
    else the setting's, else unknown. Statements and counts of a turn meet in a window, in the tasks that have the file."""
    turn, model = _stated()
    states = turn.isNotNull() & model.isNotNull()
    judged = _judged(lines.where(_counted() | states))
    kept = _counted() & F.col("drop_reason").isNull()
    judged = judged.withColumn("token_event_ordinal", F.count_if(kept).over(_so_far()) - 1).where(kept | states)
    judged = judged.withColumn("candidate_turn", F.when(kept, F.coalesce("turn_id", "current_turn")).otherwise(turn))
    stated = F.when(states & ~kept, F.struct(F.col("line"), model.alias("model")))
    events = judged.withColumn("turn_model", F.max(stated).over(Window.partitionBy("path", "candidate_turn"))["model"]).where(kept)
    known = F.col("current_model") != "unknown"
    active = F.col("overridden") & (F.col("candidate_turn") == F.col("current_turn")) & known
    events = events.withColumn("final_model", F.when(active, F.col("current_model")).otherwise(F.coalesce("turn_model", F.when(known, F.col("current_model")), F.lit("unknown"))))
    events = events.withColumn("active", active).withColumn("provisional", ~active & F.col("turn_model").isNull() & known & (F.col("candidate_turn") != ""))
    u = F.col("usage")
    signature = F.to_json(F.array(*[x.cast("string") for x in (F.col("ts"), F.col("candidate_turn"), u["input"], u["cached"], u["output"], u["reasoning"], F.col("cumulative_snapshot"))]))
    columns = {
        "timestamp": F.col("ts"), "timestamp_epoch_ms": timestamp_epoch_ms(F.col("ts")), "token_event_ordinal": F.col("token_event_ordinal").cast("long"), "turn_id": F.col("candidate_turn"),
        "model": F.col("final_model"), "input_tokens": u["input"], "cached_input_tokens": u["cached"], "output_tokens": u["output"], "reasoning_output_tokens": u["reasoning"], "event_signature": signature,
    }
    return events.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in EVENT_COLUMNS], "provisional", "active")

def _with_statements(lines: DataFrame) -> DataFrame:
    turn, model = _stated()
    both = turn.isNotNull() & model.isNotNull()
    return lines.withColumn("stated_turn", F.when(both, turn)).withColumn("stated_model", F.when(both, model))

def parse(rows: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df, tasks: int | None = None) -> dict[str, DataFrame]:
    """events, metadata, drops (path, drop_reason, count), turns (path, turn_id, unresolved, provisional) of records, and
    the state (path, state) that appended records go on from. rows are read for attributes, gates and lines: hand over a written table. keep:
    may write the lines, which all of these read. tasks: of the windows (spread), else Spark's choice."""
    meta = metadata(rows)
    lines = keep(with_turns(gated(rows, meta, tasks)))
    counts = candidates(lines)
    events = attributed(lines)
    open_turns = events.where((F.col("model") == "unknown") | F.col("provisional")).groupBy("path", "turn_id")
    return {
        "metadata": meta, "events": events.drop("provisional", "active"), "states": resume.states(_with_statements(lines), counts, events, meta),
        "drops": counts.where("drop_reason is not null").groupBy("path", "drop_reason").count(),
        "turns": open_turns.agg(F.max(F.col("model") == "unknown").alias("unresolved"), F.max("provisional").alias("provisional")),
    }
