"""State transitions of the ledger's tables: old table and input rows to the new table.

Inputs are keyed; upserts are outer joins on the key, deletions anti joins. A new snapshot is built from these and
published at once (sources.ledger), so a failure leaves the last one in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import schema

EVENT_KEY = ["rollout_id", "token_event_ordinal"]


class Conflict(Exception):
    """An input contradicts what the ledger holds."""


def append_events(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with the events of `new` whose key it lacks, and one row (inserted, ignored). A key that is present
    with another signature is a Conflict: nothing is appended."""
    new = schema.checked(new, schema.invalid_event(), "event")
    present = old.select(*EVENT_KEY, F.col("event_signature").alias("_there"), F.lit(True).alias("_present"))
    marked = new.join(present, EVENT_KEY, "left")
    clash = marked.where(F.col("_present") & ~F.col("_there").eqNullSafe(F.col("event_signature"))).select(*EVENT_KEY).head()
    if clash is not None:
        raise Conflict(f"conflicting usage event at {clash[0]}:{clash[1]}")
    counts = marked.agg(F.count_if(F.col("_present").isNull()).alias("inserted"), F.count_if(F.col("_present")).alias("ignored"))
    return old.unionByName(marked.where("_present is null").select(*old.columns)), counts


def replace_events(old: DataFrame, new: DataFrame, rollouts: DataFrame) -> DataFrame:
    """All events of the given rollouts (rollout_id) replaced by those of `new`."""
    new = schema.checked(new, schema.invalid_event(), "event")
    return old.join(rollouts.select("rollout_id").distinct(), "rollout_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def _upsert(old: DataFrame, new: DataFrame, key: str, rules: dict[str, Column] | None = None, fresh: dict[str, Column] | None = None) -> DataFrame:
    """rules: columns that depend on both sides (o.x, n.x) where the key was there; fresh: of rows that are new."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there, given, out = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull(), []
    for c in old.columns:
        taken = F.col(f"n.{c}") if c in new.columns else F.col(f"o.{c}")
        both, first = (rules or {}).get(c, taken), (fresh or {}).get(c, F.col(f"n.{c}") if c in new.columns else F.lit(None))
        out.append(F.when(there & given, both).when(given, first).otherwise(F.col(f"o.{c}")).cast(old.schema[c].dataType).alias(c))
    return joined.select(*out)


def upsert_rollouts(old: DataFrame, new: DataFrame, observed_ms: int) -> DataFrame:
    """The last writer wins, but activity never goes back, and canonical path and creation time stay."""
    new = schema.checked(new, schema.invalid_rollout(), "rollout").drop("canonical_source_path", "created_at_epoch_ms", "updated_at_epoch_ms")
    now = F.lit(observed_ms).cast("long")
    rules = {"last_activity_epoch_ms": F.greatest("o.last_activity_epoch_ms", "n.last_activity_epoch_ms"), "canonical_source_path": F.col("o.canonical_source_path"), "created_at_epoch_ms": F.col("o.created_at_epoch_ms"), "updated_at_epoch_ms": now}
    return _upsert(old, new, "rollout_id", rules, {"created_at_epoch_ms": now, "updated_at_epoch_ms": now})


def upsert_sources(old: DataFrame, new: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new sources and checkpoints: a source that is absent or not canonical loses its checkpoint."""
    new = schema.checked(new, schema.invalid_source(), "source")
    lost = new.where("not is_present or canonical_status <> 'canonical'").select("file_path")
    return _upsert(old, new, "file_path"), checkpoints.join(lost, "file_path", "left_anti").select(*checkpoints.columns)


def upsert_checkpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    return _upsert(old, new, "file_path")


def promote(rollouts: DataFrame, sources: DataFrame, checkpoints: DataFrame, chosen: DataFrame, at_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chosen (rollout_id, path, resolved: path of a conflict that is settled, or null): path becomes canonical, the
    former canonical source and the settled conflict candidates; other checkpoints of the rollout go."""
    c = chosen.select(F.col("rollout_id").alias("_r"), F.col("path").alias("_path"), F.col("resolved").alias("_resolved"))
    valid = sources.where("is_present").join(c, (F.col("rollout_id") == F.col("_r")) & (F.col("file_path") == F.col("_path"))).select("_r")
    wrong = c.join(valid, "_r", "left_anti").unionByName(c.where("_path = _resolved"))
    if not wrong.isEmpty():
        raise Conflict("the chosen source is no present candidate of its rollout")
    s = sources.join(c, F.col("rollout_id") == F.col("_r"), "left")
    settled = F.coalesce((F.col("file_path") == F.col("_resolved")) & (F.col("canonical_status") == "conflict"), F.lit(False))
    hit, mine = F.col("_r").isNotNull(), F.col("file_path") == F.col("_path")
    status = F.when(~hit, F.col("canonical_status")).when(mine, "canonical").when(settled | (F.col("canonical_status") == "canonical"), "candidate").otherwise(F.col("canonical_status"))
    changed = s.select(*[{"canonical_status": status, "last_error": F.when(~settled, F.col("last_error")), "last_scanned_at_epoch_ms": F.when(hit & mine, F.lit(at_ms)).otherwise(F.col("last_scanned_at_epoch_ms"))}.get(x, F.col(x)).alias(x) for x in sources.columns])
    r = rollouts.join(c, F.col("rollout_id") == F.col("_r"), "left")
    named = r.select(*[{"canonical_source_path": F.coalesce("_path", "canonical_source_path"), "updated_at_epoch_ms": F.when(F.col("_r").isNotNull(), F.lit(at_ms)).otherwise(F.col("updated_at_epoch_ms"))}.get(x, F.col(x)).alias(x) for x in rollouts.columns])
    kept = checkpoints.join(c, (F.col("rollout_id") == F.col("_r")) & (F.col("file_path") != F.col("_path")), "left_anti").select(*checkpoints.columns)
    return named, changed, kept


def rekey(tables: dict[str, DataFrame], old_id: str, new_id: str) -> dict[str, DataFrame]:
    """A legacy rollout id renamed everywhere. The old id must have one present canonical source, the new one no rollout."""
    canonical = tables["source_files"].where((F.col("rollout_id") == old_id) & (F.col("canonical_status") == "canonical") & F.col("is_present")).count()
    if canonical != 1 or not tables["rollouts"].where(F.col("rollout_id") == new_id).isEmpty():
        raise Conflict(f"{old_id} cannot be renamed")
    named = F.when(F.col("rollout_id") == old_id, new_id).otherwise(F.col("rollout_id"))
    return {n: tables[n].withColumn("rollout_id", named) for n in ("rollouts", "usage_events", "source_files", "rollout_checkpoints")}


def missing_sources(sources: DataFrame, found: DataFrame) -> DataFrame:
    """file_path of sources that count as present but were not found (file_path)."""
    return sources.where("is_present").join(found.select("file_path"), "file_path", "left_anti").select("file_path")


def mark_missing(sources: DataFrame, checkpoints: DataFrame, missing: DataFrame, at_ms: int) -> tuple[DataFrame, DataFrame]:
    """Sources become absent and lose their checkpoints; the history of their rollouts stays."""
    m = missing.select("file_path", F.lit(True).alias("_missing")).distinct()
    s = sources.join(m, "file_path", "left")
    gone = F.coalesce("_missing", F.lit(False))
    out = s.select(*[{"is_present": F.col("is_present") & ~gone, "last_scanned_at_epoch_ms": F.when(gone, F.lit(at_ms)).otherwise(F.col("last_scanned_at_epoch_ms"))}.get(x, F.col(x)).alias(x) for x in sources.columns])
    return out, checkpoints.join(m, "file_path", "left_anti").select(*checkpoints.columns)


def record_conflicts(sources: DataFrame, checkpoints: DataFrame, diagnostics: DataFrame, found: DataFrame, at_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """found (file_path, message): sources in conflict keep their ledger rows, lose their checkpoint and are reported."""
    f = found.select("file_path", F.col("message").alias("_message"))
    hit = F.col("_message").isNotNull()
    out = sources.join(f, "file_path", "left").select(*[{"canonical_status": F.when(hit, "conflict").otherwise(F.col("canonical_status")), "last_error": F.coalesce("_message", "last_error")}.get(x, F.col(x)).alias(x) for x in sources.columns])
    report = f.select(F.xxhash64("file_path", "_message", F.lit(at_ms)).alias("diagnostic_id"), F.lit(None).cast("string").alias("run_id"), "file_path", F.lit("warning").alias("severity"), F.lit("source_conflict").alias("code"), F.col("_message").alias("message"), F.lit(None).cast("string").alias("details_json"), F.lit(at_ms).cast("long").alias("created_at_epoch_ms"))
    return out, checkpoints.join(f, "file_path", "left_anti").select(*checkpoints.columns), diagnostics.unionByName(report)


def synchronise_titles(rollouts: DataFrame, titles: DataFrame, authoritative: bool) -> tuple[DataFrame, bool]:
    """Titles (conversation_id, title) of main threads that are no voice sessions; an authoritative index also clears
    the titles it lacks. Returns whether any title differs: identical titles are no change."""
    t = titles.select("conversation_id", F.col("title").alias("_title"))
    mine = (F.col("thread_type") == "main") & ~F.col("is_realtime_voice")
    new = F.when(mine, F.coalesce("_title", F.lit("") if authoritative else F.col("thread_title"))).otherwise(F.col("thread_title"))
    joined = rollouts.join(t, "conversation_id", "left").withColumn("_new", new)
    changed = not joined.where(~F.col("_new").eqNullSafe(F.col("thread_title"))).isEmpty()
    return joined.withColumn("thread_title", F.col("_new")).select(*rollouts.columns), changed


def finish_run(runs: DataFrame, run_id: str, at_ms: int, status: str, error: str | None = None) -> DataFrame:
    """A run that is running gets its end; any other state of it is an error."""
    if runs.where((F.col("run_id") == run_id) & (F.col("status") == "running")).isEmpty():
        raise Conflict(f"{run_id} is not running")
    mine = F.col("run_id") == run_id
    return runs.withColumn("status", F.when(mine, status).otherwise(F.col("status"))).withColumn("completed_at_epoch_ms", F.when(mine, F.lit(at_ms).cast("long")).otherwise(F.col("completed_at_epoch_ms"))).withColumn("error", F.when(mine, F.lit(error)).otherwise(F.col("error")))


def heartbeat(runs: DataFrame, run_id: str, at_ms: int) -> DataFrame:
    mine = (F.col("run_id") == run_id) & (F.col("status") == "running")
    return runs.withColumn("heartbeat_at_epoch_ms", F.when(mine, F.lit(at_ms).cast("long")).otherwise(F.col("heartbeat_at_epoch_ms")))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at_epoch_ms"), F.desc("run_id")).limit(1)


def observation_gaps(runs: DataFrame) -> DataFrame:
    """run_id, gap_start_ms, gap_end_ms: from the end (or last sign) of a run to the start of the next."""
    order = Window.orderBy("started_at_epoch_ms", "run_id")  # one row a run of the collector: a short table
    last = F.lag(F.coalesce("completed_at_epoch_ms", "heartbeat_at_epoch_ms", "started_at_epoch_ms")).over(order)
    return runs.select("run_id", last.alias("gap_start_ms"), F.col("started_at_epoch_ms").alias("gap_end_ms")).where("gap_start_ms < gap_end_ms")


def put_state(state: DataFrame, new: DataFrame) -> DataFrame:
    return _upsert(state, new, "key")


def event_cursor(events: DataFrame) -> DataFrame:
    """Events and next ordinal of each rollout."""
    return events.groupBy("rollout_id").agg(F.count("*").alias("events"), (F.max("token_event_ordinal") + 1).alias("next_ordinal"))


def ledger_tail(events: DataFrame) -> DataFrame:
    """The last event of each rollout."""
    rest = [c for c in events.columns if c != "rollout_id"]
    return events.groupBy("rollout_id").agg(F.max_by(F.struct(*rest), "token_event_ordinal").alias("t")).select("rollout_id", "t.*")


def repeated_diagnostics(diagnostics: DataFrame, code: str) -> DataFrame:
    """The largest number of equal reports (path, message) of a code."""
    return diagnostics.where(F.col("code") == code).groupBy("file_path", "message").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"))


def source_counts(sources: DataFrame) -> DataFrame:
    """conflicts, present: sources that are there, and those of them in conflict; one row."""
    return sources.agg(F.count_if((F.col("canonical_status") == "conflict") & F.col("is_present")).alias("conflicts"), F.count_if("is_present").alias("present"))
