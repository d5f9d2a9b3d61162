"""Keeping the ledger up to date: from changed files to one published snapshot, in batch and as a stream."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ledgerloom import schema
from ledgerloom.functions.text import fallback_rollout_id, is_uuid_v7, legacy_rollout_id
from ledgerloom.operators import attribution, canonical, copies, mutations, resume
from ledgerloom.operators.threads import unknown_model_sources
from ledgerloom.sources import logs, records
from ledgerloom.sources.ledger import BUCKETED, Ledger
from ledgerloom.sources.paths import assert_writable
from ledgerloom.sources.staging import cut

from .growing_files import FACTS, GrowingFiles

#: A stored revision of the parsing rules; a ledger with another one is rebuilt from all files.
PARSER_REVISION = 1
#: Times that files are read again before a session that keeps changing waits for the next inventory.
REREADINGS = 4
#: A report of the same file and message is not repeated within this time.
REPORT_AGAIN_MS = 5 * 60_000


# --- what is read -----------------------------------------------------------------------------------------------------


def changed_files(inventory: DataFrame, sources: DataFrame, rollouts: DataFrame | None = None, unknown: DataFrame | None = None) -> DataFrame:
    """Files that are new, differ in size or time, are in conflict, belong to a session whose canonical file is gone (with
    rollouts) or are canonical files with unknown models (unknown: file_path). Contents are not read."""
    known = sources.select("file_path", F.col("rollout_id").alias("_id"), F.col("size_bytes").alias("_size"), F.col("modified_at_epoch_ms").alias("_ms"), F.col("canonical_status").alias("_status"), F.col("is_present").alias("_present"))
    files = inventory.join(known, "file_path", "left")
    now = F.unix_millis("modified_at") if "modified_at" in inventory.columns else F.col("modified_at_epoch_ms")
    same = (F.col("size_bytes") == F.col("_size")) & (now == F.col("_ms")) & (F.col("_status") != "conflict") & F.col("_present")
    again = ~F.coalesce(same, F.lit(False))
    if rollouts is not None:
        there = inventory.select(F.col("file_path").alias("canonical_source_path"))
        orphans = rollouts.where("canonical_source_path is not null").join(there, "canonical_source_path", "left_anti").select(F.col("rollout_id").alias("_id"), F.lit(True).alias("_orphan"))
        files = files.join(orphans, "_id", "left")
        again = again | F.coalesce("_orphan", F.lit(False))
    if unknown is not None:
        files = files.join(unknown.select("file_path", F.lit(True).alias("_unknown")).distinct(), "file_path", "left")
        again = again | F.coalesce("_unknown", F.lit(False))
    return files.where(again).select(*inventory.columns)


@dataclass
class Parsed:
    """Files that were read: facts (path, size_bytes, modified_at_epoch_ms, stable_length, boundary_hash, content_hash,
    error, damaged, partial) with the attributes of those that count, their events, and what was dropped."""

    files: DataFrame
    events: DataFrame
    drops: DataFrame
    states: DataFrame


def parsed(rows: DataFrame, facts: DataFrame) -> Parsed:
    """Attributes and events of the records of files; a file with one damaged record gives none."""
    harmless = F.col("class").isin("oversized_opaque", "null_padding")
    classes = rows.groupBy("path").agg(F.max(~F.col("class").isin(schema.OBJECT, *schema.HARMLESS)).alias("damaged"), F.count_if(harmless).alias("skipped"), F.count_if(F.col("class") == "oversized_opaque").alias("large"))
    found = attribution.parse(rows.join(classes.where("damaged"), "path", "left_anti"), lambda lines: cut(lines, "lines"))
    # a file without a complete record still is a session, by its name
    blank = facts.join(rows.select("path").distinct(), "path", "left_anti").where("error is null").select("path", F.lit(False).alias("damaged"), F.lit(0).alias("skipped"), F.lit(0).alias("large"))
    partial = F.when(F.col("skipped") > 0, F.concat(F.lit("skipped "), F.col("large"), F.lit(" oversized and "), F.col("skipped") - F.col("large"), F.lit(" padding records")))
    files = facts.join(classes.unionByName(blank), "path", "left").withColumn("damaged", F.coalesce("damaged", F.lit(False))).withColumn("partial", partial).drop("skipped", "large")
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda x: cut(*x), [(files.join(found["metadata"], "path", "left"), "files"), (found["events"], "events")]))
    return Parsed(*done, found["drops"], found["states"])


def read_files(files: DataFrame) -> Parsed:
    """The files (logs.FILES) in one reading."""
    scanned = logs.scan(files)
    return parsed(logs.records_of(scanned), logs.facts(scanned, files))


def listed_now(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """logs.FILES of the given paths as they are now; those that are gone are left out."""
    arrow = pa.schema([("file_path", pa.string()), ("size_bytes", pa.int64()), ("modified_at_epoch_ms", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                with contextlib.suppress(OSError):
                    size, ns = logs.facts_of_file(path)
                    rows.append({"file_path": path, "size_bytes": size, "modified_at_epoch_ms": ns // 1_000_000})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return cut(paths.select("path").distinct().mapInArrow(run, logs.FILES), "listed")


# --- inventories ------------------------------------------------------------------------------------------------------


def ingest(ledger: Ledger, *roots: str, rebuild: bool = False, titles: str | None = None, now_ms: int | None = None) -> int:
    """One inventory: reads changed files in one pass, rejects damaged ones whole, decides on copies and publishes a
    snapshot. Returns the revision.

    The run's row is published when it begins, so a driver that dies leaves a run without an end. A rebuild reads all files
    and takes each session from one of them; the stored parser revision advances only when every session could be
    rebuilt. titles: path of an index of session titles; one without invalid records also clears the titles it lacks.
    A run that fails is recorded as failed and changes nothing else.
    """
    spark, now = ledger.spark, int(time.time() * 1000) if now_ms is None else now_ms
    stored = ledger.read("collector_state").where("key = 'parser_revision'").select("value").head()
    rebuild = rebuild or (stored is not None and stored[0] != str(PARSER_REVISION))
    run = uuid.uuid4().hex
    begun = spark.createDataFrame([(run, "rebuild" if rebuild else "inventory", "running", now, now, None, None, None, None)], schema.RUNS)
    ledger.commit(collector_runs=ledger.read("collector_runs").unionByName(begun))
    ended = lambda: int(time.time() * 1000) if now_ms is None else now
    try:
        changed = _inventory(ledger, roots, rebuild, stored is None, titles, now, run)
        runs = mutations.finish_run(mutations.heartbeat(ledger.read("collector_runs"), run, ended()), run, ended(), "completed")
        mine = F.col("run_id") == run
        for column in ("files_seen", "files_changed"):
            runs = runs.withColumn(column, F.when(mine, F.lit(changed.pop(column))).otherwise(F.col(column)))
        return ledger.commit(**changed, collector_runs=runs)
    except Exception as error:
        with contextlib.suppress(Exception):
            ledger.commit(collector_runs=mutations.finish_run(ledger.read("collector_runs"), run, ended(), "failed", str(error)[:500]))
        raise


def _inventory(ledger: Ledger, roots: tuple[str, ...], rebuild: bool, first: bool, titles: str | None, now: int, run: str) -> dict:
    """What to commit: changed tables, files found and files read."""
    spark, sources, rollouts = ledger.spark, ledger.read("source_files"), ledger.read("rollouts")
    found, failures = logs.listing(spark, *roots)
    unknown = None
    if not getattr(ledger, "unknown_models_tried", False):  # once for each opened ledger
        unknown, ledger.unknown_models_tried = unknown_model_sources(ledger.read("usage_events"), rollouts), True
    todo = cut(found if rebuild else changed_files(found, sources, rollouts, unknown), "changed-files")
    gone = cut(mutations.missing_sources(sources, found), "gone")
    seen, taken = found.count(), todo.count()
    lost = failures.select(F.col("path").alias("file_path"), F.lit("folder-unreadable").alias("reason"), "message")
    changed: dict = {"files_seen": seen, "files_changed": taken}
    complete, usage = failures.isEmpty(), False
    if taken or not gone.isEmpty():
        outcome = apply(ledger, read_files(todo) if taken else None, gone, rebuild, now)
        changed |= outcome.tables | {"touched": outcome.touched}
        lost = lost.unionByName(outcome.reports)
        complete, usage = complete and outcome.complete, outcome.usage_changed
    if titles is not None:
        try:
            index, invalid = records.stable_titles(spark, titles)
        except (records.UnstableIndex, OSError) as error:
            complete, told = False, ("session-index-failed", str(error)[:500])
        else:
            told = ("session-index-invalid-records", f"{invalid} invalid records of the index of titles were left out") if invalid else None
            _titled(ledger, changed, rollouts, index, invalid == 0)
        if told:
            lost = lost.unionByName(spark.createDataFrame([(titles, *told)], "file_path string, reason string, message string"))
    changed["appended"] = {"collector_diagnostics": reports(lost, ledger.read("collector_diagnostics"), now, run)}
    after = changed.get("source_files")
    rest = sources if after is None else sources.where(~ledger.bucket(F.col("rollout_id")).isin(changed["touched"])) if "touched" in changed else sources.where("false")
    status = (rest if after is None else after.unionByName(rest)).where("is_present").agg(F.count_if(F.col("canonical_status") == "conflict").alias("conflicts"), F.count_if(F.col("last_error").startswith("skipped ")).alias("partial")).head()
    covered = complete and not status["partial"]
    state = [("phase", phase_after_inventory(complete, covered, status["conflicts"]), now)]
    if covered:
        state.append(("last_inventory", str(now), now))
    if first or not rebuild or complete:
        state.append(("parser_revision", str(PARSER_REVISION), now))
    changed["collector_state"] = advanced(ledger.read("collector_state"), spark.createDataFrame(state, schema.STATE), usage, now)
    return changed


def _titled(ledger: Ledger, changed: dict, rollouts: DataFrame, index: DataFrame, authoritative: bool) -> None:
    """Puts titles into the rollouts that are to be committed: they may belong to any session, so all buckets are written
    if any title differs."""
    others = lambda t: ledger.read(t).where(~ledger.bucket(F.col("rollout_id")).isin(changed["touched"]))
    base = changed["rollouts"].unionByName(others("rollouts")) if "touched" in changed else rollouts
    named, different = mutations.synchronise_titles(base, index, authoritative)
    if different:
        for name in BUCKETED[1:] if "touched" in changed else ():
            changed[name] = changed[name].unionByName(others(name))
        changed["rollouts"] = named
        changed.pop("touched", None)


def advanced(state: DataFrame, new: DataFrame, usage_changed: bool, now: int) -> DataFrame:
    """The state with new values; the usage revision counts the changes that queries can show."""
    state = mutations.put_state(state, new)
    if not usage_changed:
        return state
    revision = state.where("key = 'usage_revision'").agg(F.coalesce(F.max(F.col("value").cast("long")), F.lit(0)) + 1)
    row = revision.toDF("n").select(F.lit("usage_revision").alias("key"), F.col("n").cast("string").alias("value"), F.lit(now).cast("long").alias("updated_at_epoch_ms"))
    return mutations.put_state(state, row)


def reports(new: DataFrame, known: DataFrame, now: int, run: str | None = None) -> DataFrame:
    """Diagnostics of new (file_path, reason, message); what was reported within REPORT_AGAIN_MS is not repeated."""
    recent = known.where(F.col("created_at_epoch_ms") > now - REPORT_AGAIN_MS).select("file_path", "message").distinct()
    fresh = new.where("message is not null").distinct().join(recent, ["file_path", "message"], "left_anti")
    conflict = F.col("reason").isin(*copies.MESSAGES)
    return fresh.select(
        F.xxhash64("file_path", "message", F.lit(now)).alias("diagnostic_id"), F.lit(run).cast("string").alias("run_id"), "file_path", F.when(F.col("reason") == "records-dropped", "info").otherwise("warning").alias("severity"),
        F.when(conflict, "source_conflict").otherwise(F.col("reason")).alias("code"), "message", F.when(conflict, F.to_json(F.struct("reason"))).alias("details_json"), F.lit(now).cast("long").alias("created_at_epoch_ms"),
    )


def reconcile(ledger: Ledger, *roots: str, every: float = 300.0, rounds: int | None = None, titles: str | None = None, wait: Callable[[float], None] = time.sleep) -> int:
    """Inventories again and again, `every` seconds apart, beside a stream or without one. Returns the last revision."""
    done, revision = 0, ledger.revision
    while rounds is None or done < rounds:
        if done:
            wait(every)
        revision, done = ingest(ledger, *roots, titles=titles), done + 1
    return revision


# --- from parsed files to tables --------------------------------------------------------------------------------------


@dataclass
class Outcome:
    """The buckets that change, their tables, reports (file_path, reason, message), whether all files could be taken in, and
    whether queries show anything new."""

    touched: list[int]
    tables: dict[str, DataFrame]
    reports: DataFrame
    complete: bool
    usage_changed: bool


def apply(ledger: Ledger, read: Parsed | None, gone: DataFrame, rebuild: bool, now: int) -> Outcome:
    """Decides on the files that were read and marks those that are gone (file_path). Only buckets of sessions they
    belong, or belonged, to are read and written."""
    sources = ledger.read("source_files")
    ids = sources.join(gone.select("file_path"), "file_path", "left_semi").select("rollout_id")
    if read is not None:
        own = read.files.select("rollout_id", F.col("path").alias("file_path"))
        ids = ids.unionByName(own.select("rollout_id")).unionByName(sources.join(own.select("file_path"), "file_path", "left_semi").select("rollout_id"))
    touched = sorted(r[0] for r in ids.select(ledger.bucket(F.col("rollout_id"))).distinct().collect())  # one number a bucket
    tables = {t: ledger.read(t, buckets=touched) for t in BUCKETED}
    tables["source_files"], tables["rollout_checkpoints"] = mutations.mark_missing(tables["source_files"], tables["rollout_checkpoints"], gone, now)
    none = ledger.spark.createDataFrame([], "file_path string, reason string, message string")
    if read is None:
        return Outcome(touched, tables, none, True, False)
    tables, decided, waiting = decide(tables, read, rebuild, now)
    failed = read.files.where("damaged or error is not null").select(F.col("path").alias("file_path"), F.when(F.col("damaged"), "source-malformed").otherwise("source-unreadable").alias("reason"), F.when(F.col("damaged"), "damaged record").otherwise(F.col("error")).alias("message"))
    failed = failed.where("message <> 'gone'").join(decided.select(F.col("path").alias("file_path")), "file_path", "left_anti").select("file_path", "reason", "message")
    late = waiting.select(F.col("path").alias("file_path"), F.lit("source-changing").alias("reason"), F.lit("the file changed between two readings").alias("message"))
    dropped = read.drops.groupBy("path").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("drop_reason", "count"))))).alias("message")).select(F.col("path").alias("file_path"), F.lit("records-dropped").alias("reason"), "message")
    told = decided.where("message is not null").select(F.col("path").alias("file_path"), "reason", "message")
    flags = decided.agg(F.max("usage_changed").alias("usage"), F.count_if(F.col("decision").isin("reject", *(("broken", "moved") if rebuild else ()))).alias("bad")).head()
    complete = failed.isEmpty() and waiting.isEmpty() and not flags["bad"]
    return Outcome(touched, tables, told.unionByName(failed).unionByName(late).unionByName(dropped), complete, bool(flags["usage"]))


def _known(files: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """files with what the ledger knows of them, the fold's kind and the session they are decided in."""
    sources = tables["source_files"].select(F.col("file_path").alias("path"), F.col("rollout_id").alias("stored_id"), F.col("byte_offset").alias("stored_offset"), F.col("prefix_hash").alias("stored_hash"))
    canon = tables["rollouts"].select(F.col("rollout_id").alias("stored_id"), F.col("canonical_source_path").alias("stored_canonical"))
    x = files.join(sources, "path", "left").join(canon, "stored_id", "left")
    mine, same = F.coalesce(F.col("stored_canonical") == F.col("path"), F.lit(False)), F.col("stored_id").eqNullSafe(F.col("rollout_id"))
    name = fallback_rollout_id(F.col("path"))
    legacy = F.coalesce((F.col("stored_id") == legacy_rollout_id(F.col("path"))) & is_uuid_v7(name) & (name == F.col("rollout_id")), F.lit(False))
    kind = F.when(F.col("error").isNotNull(), None).when(F.col("damaged"), F.when(mine, "broken")).when(mine & ~same, "moved").otherwise("copy")
    shorter = (F.col("stable_length") < F.col("stored_offset")) | ((F.col("stable_length") == F.col("stored_offset")) & (F.col("boundary_hash") != F.col("stored_hash")))
    return x.select(
        "*", kind.alias("kind"), F.when(kind == "copy", F.col("rollout_id")).otherwise(F.col("stored_id")).alias("id"), legacy.alias("legacy"), (F.col("stored_id").isNull() | same | legacy).alias("expected"),
        F.coalesce(same & shorter, F.lit(False)).alias("rewritten"),
    )


def _fold_rows(files: DataFrame, events: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """copies.FOLD of the sessions of files (kind, id, sure and what _known adds)."""
    ids = files.select(F.col("id").alias("rollout_id")).distinct()
    held = tables["usage_events"].join(ids, "rollout_id", "left_semi")
    n_held = held.groupBy("rollout_id").agg(F.count("*").alias("n"))
    counted = files.where("kind in ('copy', 'seed')").join(events.groupBy("path").agg(F.count("*").alias("n")), "path", "left").select("path", "id", F.coalesce("n", F.lit(0)).alias("n"))
    counted = cut(counted, "counted")
    lengths = counted.select(F.col("id").alias("rollout_id"), "n").unionByName(n_held.select("rollout_id", "n")).where("n > 0").distinct()
    of_files = copies.prints(events.join(counted.select("path"), "path", "left_semi"), "path", counted.select("path", F.col("id").alias("rollout_id")).join(lengths, "rollout_id").select("path", "n"))
    of_ledger = copies.prints(held, "rollout_id", lengths)
    attrs = F.struct(*canonical.ATTRIBUTES)
    taken = F.when(F.col("rollout_id").isNotNull(), True)
    free = files.where("kind = 'moved'").select("path", F.col("rollout_id").alias("_to")).join(tables["rollouts"].select(F.col("rollout_id").alias("_to"), taken.alias("_taken")), "_to", "left").join(files.where("kind = 'copy'").select(F.col("rollout_id").alias("_to"), F.lit(True).alias("_read")).distinct(), "_to", "left")
    free = free.select("path", (F.col("_taken").isNull() & F.col("_read").isNull()).alias("target_free"))
    blank = {f.split()[0]: F.lit(None).cast(f.split(" ", 1)[1]) for f in _fields(copies.FOLD)} | {"rewritten": F.lit(False)}
    row = lambda df, **given: df.select(*[given.get(c, v).alias(c) for c, v in blank.items()])
    x = files.join(counted.select("path", "n"), "path", "left").join(of_files, "path", "left").join(free, "path", "left")
    read = row(
        x, rollout_id=F.col("id"), n=F.coalesce("n", F.lit(0)), attrs=attrs, title=F.lit(None).cast("string"), activity=F.col("last_activity_epoch_ms"), target_free=F.coalesce("target_free", F.lit(False)),
        **{c: F.col(c) for c in ("kind", "path", "prints", "stable_length", "size_bytes", "modified_at_epoch_ms", "boundary_hash", "sure", "expected", "legacy", "rewritten")},
    )
    s = tables["rollouts"].join(ids, "rollout_id", "left_semi").join(n_held, "rollout_id", "left").join(of_ledger, "rollout_id", "left")
    stored = row(s, rollout_id=F.col("rollout_id"), kind=F.lit("stored"), path=F.col("canonical_source_path"), n=F.coalesce("n", F.lit(0)), prints=F.col("prints"), attrs=attrs, activity=F.col("last_activity_epoch_ms"))
    k = tables["source_files"].join(ids, "rollout_id", "left_semi")
    known = row(k, rollout_id=F.col("rollout_id"), kind=F.lit("source"), path=F.col("file_path"), status=F.col("canonical_status"), present=F.col("is_present"))
    return read.unionByName(stored).unionByName(known)


def _fields(ddl: str) -> list[str]:
    """The fields of a DDL list whose types may hold commas in angle brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(ddl):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(ddl[last:i].strip())
            last = i + 1
    return [*out, ddl[last:].strip()]


def decide(tables: dict[str, DataFrame], read: Parsed, rebuild: bool, now: int, again: Callable[[DataFrame], Parsed] | None = None) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The tables after deciding on all files that were read, the decisions, and files (path) that wait as they keep changing.

    Sessions with a single new file need no comparison. The others are folded; where the fold asks for files (a
    canonical file that lost or changed events, candidates for a recovery), these are read again and only what both
    readings agree on counts.
    """
    spark = read.files.sparkSession
    again = again or (lambda paths: read_files(listed_now(spark, paths)))
    known = _known(read.files, tables).where("kind is not null").withColumn("sure", F.lit(False))
    there = tables["rollouts"].select(F.col("rollout_id").alias("id")).unionByName(tables["source_files"].select(F.col("rollout_id").alias("id"))).where("id is not null").distinct()
    several = known.groupBy("id").agg(F.count("*").alias("_files")).join(there.withColumn("_there", F.lit(True)), "id", "left")
    lone = (F.col("_files") == 1) & F.col("_there").isNull() & (F.col("kind") == "copy") & F.col("stored_id").isNull()
    files = cut(known.join(several, "id").withColumn("lone", lone).drop("_files", "_there"), "known")
    alone = files.where("lone").select(F.col("id").alias("rollout_id"), "path", F.lit("promote").alias("decision"), F.lit("canonical").alias("status"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("reason"), F.lit(True).alias("taken"), F.lit(False).alias("free"), F.lit(None).cast("string").alias("needs"), F.lit(True).alias("usage_changed"))
    open_, events = files.where("not lone").drop("lone"), read.events
    files = files.drop("lone")
    done, waiting, states = [alone], None, read.states
    every = files
    for _ in range(REREADINGS):
        if open_.isEmpty():
            break
        got = cut(copies.fold(_fold_rows(open_, events, tables), rebuild), "decided")
        done.append(got.where("needs is null"))
        asked = got.where("needs is not null").select("path", "needs", F.col("rollout_id").alias("_id"))
        waiting = asked.select("path")
        if asked.isEmpty():
            break
        open_ = open_.join(asked.select(F.col("_id").alias("id")).distinct(), "id", "left_semi")
        second = again(asked.select("path"))
        fresh_rows = second.files.join(asked, "path")
        before = open_.select("path", F.col("stable_length").alias("_stable"), F.col("boundary_hash").alias("_boundary"), F.col("content_hash").alias("_content"))
        agrees = (F.col("stable_length") == F.col("_stable")) & (F.col("boundary_hash") == F.col("_boundary")) & (F.col("_content").isNull() | (F.col("content_hash") == F.col("_content")))
        kept = fresh_rows.where("error is null").join(before, "path", "left").where((F.col("needs") != "confirm") | F.coalesce(agrees, F.lit(False)))
        seeds = (F.col("needs") == "seed") | (F.col("needs") == "fresh")
        kept = _known(kept.drop("_stable", "_boundary", "_content"), tables).where(~seeds | (F.col("kind") == "copy"))
        was_read = files.select("path", F.lit(True).alias("_read"))
        kind = F.when((F.col("needs") == "seed") & F.col("_read").isNull(), "seed").otherwise(F.col("kind"))
        kept = kept.join(was_read, "path", "left").withColumn("kind", kind).withColumn("id", F.when(F.col("kind").isin("seed", "copy"), F.col("rollout_id")).otherwise(F.col("id"))).withColumn("sure", F.lit(True))
        unsettled = fresh_rows.select("path", "_id").join(kept.select("path"), "path", "left_anti")
        states = states.join(asked.select("path"), "path", "left_anti").unionByName(second.states)
        open_ = cut(open_.join(asked.select("path"), "path", "left_anti").unionByName(kept.select(*open_.columns)), "open")
        every = cut(every.join(asked.select("path"), "path", "left_anti").unionByName(kept.select(*every.columns)), "every")
        events = cut(events.join(asked.select("path"), "path", "left_anti").unionByName(second.events), "events")
        waiting = unsettled.select("path").unionByName(asked.select("path").join(second.files.select("path"), "path", "left_anti"))
    decided = done[0]
    for d in done[1:]:
        decided = decided.unionByName(d)
    waiting = waiting if waiting is not None else files.select("path").where("false")
    tables = written(tables, every, events, states, read, decided, now)
    later = every.join(decided.where("free or decision = 'rekey'").select("path"), "path", "left_semi")
    if not later.isEmpty():
        tables = {n: cut(t, n) for n, t in tables.items()}
        renamed = not decided.where("decision = 'rekey'").isEmpty()
        columns = read.files.columns
        tables, more, wait = decide(tables, Parsed(later.select(*columns), events, read.drops, states), rebuild and renamed, now, again)
        decided, waiting = decided.unionByName(more), waiting.unionByName(wait)
    return tables, decided, waiting


def written(tables: dict[str, DataFrame], files: DataFrame, events: DataFrame, states: DataFrame, read: Parsed, decided: DataFrame, now: int) -> dict[str, DataFrame]:
    """The tables after the decisions."""
    rollouts, held, sources, checkpoints = (tables[t] for t in BUCKETED)
    # legacy ids take their new names everywhere
    names = decided.where("decision = 'rekey'").join(files.select("path", F.col("rollout_id").alias("_new")), "path").select("rollout_id", "_new")
    rename = lambda t: t.join(F.broadcast(names), "rollout_id", "left").withColumn("rollout_id", F.coalesce("_new", "rollout_id")).select(*t.columns)
    if not names.isEmpty():  # one row for each legacy file of a rebuild
        rollouts, held, sources, checkpoints = (rename(t) for t in (rollouts, held, sources, checkpoints))
    result = decided.where("decision <> 'rekey' and decision <> 'reject'").select("path", "rollout_id", "decision", "status", "message", "taken", "free")
    facts = files.join(result.withColumnsRenamed({"rollout_id": "_session"}), "path")
    whole = F.col("decision").isin("broken", "moved")  # all bytes count as seen: the file is read again when it changes
    listed = facts.where("status is not null and not free").select(
        F.col("path").alias("file_path"), F.col("_session").alias("rollout_id"), "size_bytes", "modified_at_epoch_ms", F.when(whole, F.col("size_bytes")).otherwise(F.col("stable_length")).alias("byte_offset"), F.col("boundary_hash").alias("prefix_hash"),
        F.when(F.col("status") == "conflict", "diverged").otherwise("verified").alias("prefix_status"), F.col("status").alias("canonical_status"), F.lit(True).alias("is_present"), F.lit(now).cast("long").alias("last_scanned_at_epoch_ms"), F.coalesce("message", "partial").alias("last_error"),
    )
    # sources that were not read but lost or got back their place
    only = result.where("status is not null").join(files.select("path"), "path", "left_anti").select(F.col("path").alias("file_path"), F.col("status").alias("_status"), F.col("message").alias("_message"))
    s = sources.join(only, "file_path", "left")
    sources = s.select(*[{"canonical_status": F.coalesce("_status", "canonical_status"), "last_error": F.when(F.col("_status").isNull(), F.col("last_error")).otherwise(F.col("_message"))}.get(c, F.col(c)).alias(c) for c in sources.columns])
    moved_on = facts.where("free").select(F.col("path").alias("file_path"))
    sources = sources.join(moved_on, "file_path", "left_anti").select(*sources.columns)
    sources, checkpoints = mutations.upsert_sources(sources, listed, checkpoints)
    # files that could not be taken in keep their place and say why
    failed = read.files.where("damaged or (error is not null and error <> 'gone')").join(result.select("path"), "path", "left_anti").select(F.col("path").alias("file_path"), "size_bytes", "modified_at_epoch_ms", F.when(F.col("damaged"), "damaged record").otherwise(F.col("error")).alias("last_error"), "damaged")
    known = sources.drop("last_error").join(failed.select("file_path", "last_error"), "file_path").select(*sources.columns)
    new = failed.where("damaged").join(sources.select("file_path"), "file_path", "left_anti")
    blank = {f.name: F.lit(None).cast(f.dataType) for f in schema.struct(schema.SOURCES)} | {"byte_offset": F.lit(0).cast("long"), "prefix_status": F.lit("unknown"), "canonical_status": F.lit("candidate"), "is_present": F.lit(True)}
    new = new.select(*[F.col(c).alias(c) if c in new.columns else v.alias(c) for c, v in blank.items()])
    sources, checkpoints = mutations.upsert_sources(sources, known.unionByName(new), checkpoints)
    # the taken copies
    taken = facts.where("taken").join(rollouts.select("rollout_id", F.col("thread_title").alias("_title")), "rollout_id", "left").withColumn("thread_title", F.coalesce("_title", F.lit("")))
    taken = cut(taken, "taken")
    rollouts = mutations.upsert_rollouts(rollouts, taken.select(*[c for c in schema.struct(schema.ROLLOUTS).fieldNames() if c in taken.columns]), now)
    place = taken.select("rollout_id", F.col("path").alias("_path"))
    rollouts = rollouts.join(place, "rollout_id", "left").withColumn("canonical_source_path", F.coalesce("_path", "canonical_source_path")).select(*tables["rollouts"].columns)
    held = mutations.replace_events(held, events.join(taken.select("path"), "path", "left_semi").select(*schema.struct(schema.EVENTS).fieldNames()), taken)
    checkpoints = mutations.upsert_checkpoints(checkpoints.join(place.select("rollout_id"), "rollout_id", "left_anti").select(*checkpoints.columns), checkpoint_rows(taken.join(states, "path", "left")))
    return dict(zip(BUCKETED, (rollouts, held, cut(sources, "source_files"), checkpoints), strict=True))


def checkpoint_rows(taken: DataFrame) -> DataFrame:
    """How far each canonical file was read, and the state that appended records go on from, if there is one."""
    state = F.col("state")
    return taken.select(
        F.col("path").alias("file_path"), "rollout_id", F.lit(1).alias("format_revision"), F.lit(PARSER_REVISION).alias("parser_revision"), F.concat_ws("|", "path", "size_bytes", "modified_at_epoch_ms").alias("source_identity"), F.col("size_bytes").alias("observed_size"),
        F.col("modified_at_epoch_ms").alias("observed_modified_ms"), F.col("stable_length").alias("stable_offset"), "boundary_hash", state.alias("state_json"), F.sha2(state, 256).alias("state_hash"),
    )


# --- the stream -------------------------------------------------------------------------------------------------------


def tail(spark: SparkSession, *roots: str, most_files: int = 16) -> DataFrame:
    """Stream of complete lines appended below the roots: path, offset, raw, reset; see GrowingFiles."""
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").option("roots", json.dumps(list(roots))).option("maxFilesPerTrigger", str(most_files)).load()


def typed(lines: DataFrame) -> DataFrame:
    """The lines as records; the byte offset takes the place of the line number."""
    arrow = records._arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [records.flat(p, o, r) for p, o, r in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "raw")), strict=True) if o >= 0]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return lines.select("path", "offset", "raw").mapInArrow(run, schema.RECORDS)


class LiveLedger:
    """Takes micro-batches of appended lines into a ledger.

    Lines appended to a canonical file go on from the state in its checkpoint: neither the file nor its earlier events are
    read. New, rewritten, copied and damaged files, and those where appended records change earlier events (a model that is
    stated late), are read as a whole and go through the same decisions as in an inventory; what these want confirmed is
    read again. Files that are gone are marked. A batch writes the buckets of its sessions alone; lines of one that comes
    twice lie before the checkpoints and are left out. changed: called with the ledger's revision after a batch that
    queries can see.
    """

    def __init__(self, ledger: Ledger, changed: Callable[[int], None] | None = None):
        self.ledger, self.spark, self.changed, self.run = ledger, ledger.spark, changed, uuid.uuid4().hex

    def __call__(self, lines: DataFrame, batch: int) -> None:
        lines, now = cut(lines, "tail"), int(time.time() * 1000)
        gone = cut(lines.where("offset = -2").select(F.col("path").alias("file_path")), "gone")
        appended = self._appended(lines)
        rest = lines.where("offset <> -2").select("path").distinct().join(appended.where("whole is null and token_event_ordinal is null").select("path"), "path", "left_anti")
        if not self.ledger.revision:
            rest = lines.where("offset <> -2").select("path").distinct()
        files = listed_now(self.spark, rest)
        outcome = apply(self.ledger, None if files.isEmpty() else read_files(files), gone, False, now)
        touched, tables, usage = self._append(lines, appended, outcome, now)
        state = self.spark.createDataFrame([("last_batch", str(batch), now)], schema.STATE)
        changed = tables | {"collector_state": advanced(self.ledger.read("collector_state"), state, usage, now), "collector_runs": self._runs(now)}
        told = reports(outcome.reports, self.ledger.read("collector_diagnostics"), now, self.run)
        self.ledger.commit(touched=touched, appended={"collector_diagnostics": told}, **changed)
        if usage and self.changed:
            self.changed(self.ledger.revision)

    def _appended(self, lines: DataFrame) -> DataFrame:
        """resume.RESUMED of the files that can go on from their checkpoint's end."""
        points = self.ledger.read("rollout_checkpoints").where(f"state_json is not null and parser_revision = {PARSER_REVISION}").select(F.col("file_path").alias("path"), "stable_offset", F.col("state_json").alias("state"))
        batch = lines.groupBy("path").agg(F.max("reset").alias("reset"), F.min(F.when(F.col("offset") >= 0, F.col("offset"))).alias("first"))
        held = cut(batch.where("not reset").join(points, "path").where("first <= stable_offset"), "held")
        new = lines.join(held.select("path", "stable_offset"), "path").where("offset >= stable_offset").select(*lines.columns)
        found = resume.resumed(typed(new), held)
        return cut(found, "appended")

    def _append(self, lines: DataFrame, appended: DataFrame, outcome: Outcome, now: int) -> tuple[list[int], dict[str, DataFrame], bool]:
        """The outcome's tables with the appended events, and their files' facts, activity and checkpoints."""
        ends = appended.where("token_event_ordinal is null and whole is null").select("path", "state", "activity")
        if ends.isEmpty():
            return outcome.touched, outcome.tables, outcome.usage_changed
        sources = self.ledger.read("source_files")
        ids = sources.select(F.col("file_path").alias("path"), "rollout_id").join(ends, "path")
        shots = lines.where("offset = -1").select("path", F.from_json(F.col("raw").cast("string"), FACTS).alias("f")).select("path", "f.*")
        ends = cut(ids.join(shots, "path"), "ends")
        own = sorted(r[0] for r in ends.select(self.ledger.bucket(F.col("rollout_id"))).distinct().collect())  # one number a bucket
        more = [b for b in own if b not in outcome.touched]
        tables = {n: outcome.tables[n].unionByName(self.ledger.read(n, buckets=more)) for n in BUCKETED}
        events = appended.where("token_event_ordinal is not null").join(ends.select("path", "rollout_id"), "path").select(*schema.struct(schema.EVENTS).fieldNames())
        tables["usage_events"], counts = mutations.append_events(tables["usage_events"], events)
        listed = ends.select(F.col("path").alias("file_path"), "size_bytes", "modified_at_epoch_ms", F.col("stable_length").alias("byte_offset"), F.col("boundary_hash").alias("prefix_hash"), F.lit(now).cast("long").alias("last_scanned_at_epoch_ms"))
        s = tables["source_files"].join(listed.withColumnsRenamed({c: f"_{c}" for c in listed.columns if c != "file_path"}), "file_path", "left")
        tables["source_files"] = s.select(*[F.coalesce(f"_{c}", c).alias(c) if c in listed.columns and c != "file_path" else F.col(c) for c in sources.columns])
        r = tables["rollouts"].join(ends.select("rollout_id", "activity"), "rollout_id", "left")
        columns = tables["rollouts"].columns
        tables["rollouts"] = r.withColumn("last_activity_epoch_ms", F.greatest("last_activity_epoch_ms", F.coalesce("activity", F.lit(0)))).withColumn("updated_at_epoch_ms", F.when(F.col("activity").isNotNull(), F.lit(now)).otherwise(F.col("updated_at_epoch_ms"))).select(*columns)
        tables["rollout_checkpoints"] = mutations.upsert_checkpoints(tables["rollout_checkpoints"], checkpoint_rows(ends))
        return sorted([*outcome.touched, *more]), tables, outcome.usage_changed or counts.head()["inserted"] > 0

    def _runs(self, now: int) -> DataFrame:
        """The runs with a sign of life of this stream's."""
        runs = self.ledger.read("collector_runs")
        if runs.where(F.col("run_id") == self.run).isEmpty():
            return runs.unionByName(self.spark.createDataFrame([(self.run, "stream", "running", now, now, None, None, None, None)], schema.RUNS))
        return mutations.heartbeat(runs, self.run, now)

    def finish(self, error: str | None = None) -> None:
        """The stream's run ends."""
        now = int(time.time() * 1000)
        runs = self.ledger.read("collector_runs")
        if not runs.where((F.col("run_id") == self.run) & (F.col("status") == "running")).isEmpty():
            self.ledger.commit(collector_runs=mutations.finish_run(runs, self.run, now, "failed" if error else "completed", error))
        self.run = uuid.uuid4().hex

    def start(self, *roots: str, checkpoint: str, every: str = "2 seconds", once: bool = False, most_files: int = 16, phases: Phases | None = None) -> StreamingQuery:
        assert_writable(checkpoint, *roots, *self.ledger.protected, spark=self.spark)
        if phases is not None:
            self.spark.streams.addListener(phases)
        writer = tail(self.spark, *roots, most_files=most_files).writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def with_retries(start: Callable[[], StreamingQuery], attempts: int = 5, first: float = 0.25, most: float = 4.0, sleep: Callable[[float], None] = time.sleep, phases: Phases | None = None) -> int:
    """Runs a query to its end, again after a failure, with doubling waits. Returns the number of failures."""
    for failures in range(attempts):
        try:
            start().awaitTermination()
            return failures
        except Exception:
            if failures == attempts - 1:
                if phases is not None:
                    phases.gave_up()
                raise
            if phases is not None:
                phases.waits()
            sleep(min(first * 2**failures, most))
    return attempts


class Phases(StreamingQueryListener):
    """The phase of a collector: stopped, syncing (until a batch or inventory is done), watching, partial (files or
    records are left out, or copies are in conflict), retrying (a failed query waits for its next attempt), degraded
    (an inventory failed, or no attempt is left). `changed` is told of batches that have brought rows."""

    def __init__(self, changed: Callable[[int], None] | None = None):
        self.phase, self.changed, self.retries = "stopped", changed, False

    def waits(self) -> None:
        """A query failed and is tried again."""
        self.phase, self.retries = "retrying", True

    def gave_up(self) -> None:
        self.phase, self.retries = "degraded", False

    def inventory(self, ledger: Ledger) -> str:
        """Takes the phase that the last inventory left; a query that waits for its next attempt stays so."""
        row = ledger.read("collector_state").where("key = 'phase'").select("value").head()
        if row is not None and not self.retries:
            self.phase = row[0]
        return self.phase

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        self.phase = "retrying" if self.retries else "syncing"

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        self.phase, self.retries = "watching", False
        if event.progress.numInputRows and self.changed:
            self.changed(event.progress.batchId)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        self.phase, self.retries = "watching", False

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        if self.phase != "retrying":
            self.phase = "degraded" if event.exception else "stopped"


def phase_after_inventory(succeeded: bool, fully_covered: bool, conflicts: int) -> str:
    return "degraded" if not succeeded else "watching" if fully_covered and not conflicts else "partial"


def throttled(reports: DataFrame, minutes: int = 5) -> DataFrame:
    """A stream of reports (created_at, file_path, message) without repetitions within some minutes."""
    return reports.withWatermark("created_at", f"{minutes} minutes").dropDuplicatesWithinWatermark(["file_path", "message"])
