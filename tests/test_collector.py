"""From log files on disk to the ledger, in batch and as a stream."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import canonical, mutations
from ledgerloom.sources import logs as source
from ledgerloom.sources import records
from ledgerloom.sources.ledger import Ledger
from ledgerloom.streaming import collector
from ledgerloom.streaming.growing_files import GrowingFilesReader

from .test_parser import count, meta, rec

V7 = "01990000-0000-7000-8000-0000000000{:02d}"


def write(path, *lines, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(x + "\n" for x in lines) + tail)


def append(path, *lines, tail=""):
    with path.open("a") as f:
        f.write("".join(x + "\n" for x in lines) + tail)


@pytest.fixture
def logs(tmp_path):
    return tmp_path / "logs"


@pytest.fixture
def book(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/ledger")


def events(book):
    return [(r.rollout_id, r.token_event_ordinal, r.model) for r in book.read("usage_events").orderBy("rollout_id", "token_event_ordinal").collect()]


def test_inventory_takes_log_files_only(spark, logs):
    write(logs / "a" / "rollout-x-1.jsonl", "{}")
    write(logs / "b" / "rollout-x-2.JSONL", "{}")
    write(logs / "b" / "other-3.jsonl", "{}")
    write(logs / "b" / "rollout-4.txt", "{}")
    assert sorted(os.path.basename(r.file_path) for r in records.inventory(spark, str(logs)).collect()) == ["rollout-x-1.jsonl", "rollout-x-2.JSONL"]


def test_snapshots_and_confirmation(spark, logs):
    import hashlib

    write(logs / "rollout-x-1.jsonl", "a" * 70_000, "b", tail="partial")
    shot = records.snapshots(records.contents(spark, str(logs))).head()
    whole = (logs / "rollout-x-1.jsonl").read_bytes()
    stable = whole.removesuffix(b"partial")
    assert shot.stable_length == len(stable) and shot.content_hash == hashlib.sha256(whole).hexdigest() and shot.boundary_hash == hashlib.sha256(stable[-65_536:]).hexdigest()
    first = records.snapshots(records.contents(spark, str(logs)))
    assert records.confirmed(first, first).count() == 1
    assert records.confirmed(first, first.withColumn("content_hash", F.lit("x"))).count() == 0


def test_ingest_append_and_skip(spark, logs, book):
    one, two = logs / "rollout-x-1.jsonl", logs / "rollout-x-2.jsonl"
    write(one, meta(id="r1"), rec("turn_context", turn_id="t", model="gpt-a"), count(1), tail='{"part')
    write(two, meta(id="r2"), count(1), "not-json")
    collector.ingest(book, str(logs), now_ms=1)
    assert events(book) == [("r1", 0, "gpt-a")]
    sources = {os.path.basename(r.file_path): r for r in book.read("source_files").collect()}
    assert sources["rollout-x-1.jsonl"].canonical_status == "canonical" and sources["rollout-x-2.jsonl"].last_error == "damaged record"
    todo = collector.changed_files(records.inventory(spark, str(logs)), book.read("source_files"))
    assert todo.count() == 0
    write(one, meta(id="r1"), rec("turn_context", turn_id="t", model="gpt-a"), count(1), count(2))
    collector.ingest(book, str(logs), now_ms=2)
    assert events(book) == [("r1", 0, "gpt-a"), ("r1", 1, "gpt-a")]


def test_archived_copy_takes_over_and_history_stays(spark, logs, book):
    live, archive = logs / "live" / "rollout-x-1.jsonl", logs / "old" / "rollout-x-1.jsonl"
    write(live, meta(id="r1"), count(1))
    collector.ingest(book, str(logs), now_ms=1)
    write(archive, meta(id="r1"), count(1), count(2))
    live.unlink()
    collector.ingest(book, str(logs), now_ms=2)
    assert [e[1] for e in events(book)] == [0, 1]
    sources = {"old" if "/old/" in r.file_path else "live": r for r in book.read("source_files").collect()}
    assert sources["old"].canonical_status == "canonical" and not sources["live"].is_present
    archive.unlink()
    collector.ingest(book, str(logs), now_ms=3)
    assert len(events(book)) == 2 and mutations.missing_sources(book.read("source_files"), spark.createDataFrame([], "file_path string")).count() == 0


def test_diverging_copy_is_a_conflict(spark, logs, book):
    write(logs / "a" / "rollout-x-1.jsonl", meta(id="r1"), count(1))
    write(logs / "b" / "rollout-x-1.jsonl", meta(id="r1"), count(7, last={"input_tokens": 99, "cached_input_tokens": 0, "output_tokens": 1, "reasoning_output_tokens": 0, "total_tokens": 100}))
    collector.ingest(book, str(logs), now_ms=1)
    states = sorted(r.canonical_status for r in book.read("source_files").collect())
    assert states == ["canonical", "conflict"] and len(events(book)) == 1


def test_rewritten_canonical_file_replaces_its_events(spark, logs, book):
    path = logs / "rollout-x-1.jsonl"
    write(path, meta(id="r1"), count(1), count(2))
    collector.ingest(book, str(logs), now_ms=1)
    write(path, meta(id="r1"), count(5))
    collector.ingest(book, str(logs), now_ms=2)
    assert len(events(book)) == 1


def test_rebuild_takes_one_copy_of_each_session(spark, logs, book):
    write(logs / "a" / "rollout-x-1.jsonl", meta(id="r1"), count(1), count(2), count(3))
    write(logs / "b" / "rollout-x-1.jsonl", meta(id="r1"), count(1))
    write(logs / "a" / "rollout-x-2.jsonl", meta(id="r2"), count(1))
    collector.ingest(book, str(logs), now_ms=1)
    assert len(events(book)) == 4
    collector.ingest(book, str(logs), rebuild=True, now_ms=2)
    assert [e[:2] for e in events(book)] == [("r1", 0), ("r1", 1), ("r1", 2), ("r2", 0)]
    assert sorted(r.canonical_status for r in book.read("source_files").collect()) == ["candidate", "canonical", "canonical"]
    runs = book.read("collector_runs").orderBy("started_at_epoch_ms").collect()
    assert [(r.trigger, r.status, r.files_seen, r.files_changed) for r in runs] == [("inventory", "completed", 3, 3), ("rebuild", "completed", 3, 3)]


def test_damaged_rebuild_keeps_events_and_the_old_revision(spark, logs, book, monkeypatch):
    write(logs / "rollout-x-1.jsonl", meta(id="r1"), count(1))
    collector.ingest(book, str(logs), now_ms=1)
    monkeypatch.setattr(collector, "PARSER_REVISION", 2)
    write(logs / "rollout-x-1.jsonl", meta(id="r1"), count(1), "not-json")
    stored = lambda: book.read("collector_state").where("key = 'parser_revision'").head().value
    collector.ingest(book, str(logs), now_ms=2)
    assert len(events(book)) == 1 and stored() == "1"
    write(logs / "rollout-x-1.jsonl", meta(id="r1"), count(1), count(2))
    collector.ingest(book, str(logs), now_ms=3)
    assert len(events(book)) == 2 and stored() == "2"


def test_conflicts_are_reported_and_failed_runs_recorded(spark, logs, book, monkeypatch):
    other = {"input_tokens": 99, "cached_input_tokens": 0, "output_tokens": 1, "reasoning_output_tokens": 0, "total_tokens": 100}
    for d, line in (("a", count(1)), ("b", count(7, last=other)), ("c", count(1))):
        write(logs / d / "rollout-x-1.jsonl", meta(id="r1"), line)
    collector.ingest(book, str(logs), now_ms=1)
    (report,) = book.read("collector_diagnostics").collect()
    assert report.code == "source_conflict" and "/b/" in report.file_path
    assert mutations.repeated_diagnostics(book.read("collector_diagnostics"), "source_conflict").head().most == 1
    monkeypatch.setattr(source, "listing", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        collector.ingest(book, str(logs), now_ms=5)
    last = mutations.latest_run(book.read("collector_runs")).head()
    assert last.status == "failed" and "division" in last.error and len(events(book)) == 1
    assert [tuple(r)[1:] for r in mutations.observation_gaps(book.read("collector_runs")).collect()] == [(1, 5)]


def test_a_file_that_changes_meanwhile_waits(spark, logs, book, monkeypatch):
    path = logs / "rollout-x-1.jsonl"
    write(path, meta(id="r1"), count(1), count(2))
    collector.ingest(book, str(logs), now_ms=1)
    write(path, meta(id="r1"), count(5))
    whole, readings = source.facts, []

    def changing(*given):
        readings.append(1)
        return whole(*given).withColumn("content_hash", F.lit(f"reading {len(readings)}"))

    monkeypatch.setattr(source, "facts", changing)
    collector.ingest(book, str(logs), now_ms=2)
    assert len(events(book)) == 2 and len(readings) == 2
    monkeypatch.setattr(source, "facts", whole)
    collector.ingest(book, str(logs), now_ms=3)
    assert len(events(book)) == 1


def test_titles_come_with_an_inventory(spark, logs, book, tmp_path, monkeypatch):
    index, path = tmp_path / "session_index.jsonl", logs / "rollout-x-1.jsonl"
    index.write_text(f'{{"id":"{V7.format(1)}","thread_name":"A title","updated_at":"2026-01-01T00:00:00Z"}}\n')
    write(path, meta(id="r1", session_id=V7.format(1)), count(1))
    assert collector.reconcile(book, str(logs), rounds=1, titles=str(index)) == book.revision
    assert book.read("rollouts").head().thread_title == "A title"
    append(path, count(2))
    waits, whole = [], collector.ingest
    monkeypatch.setattr(collector, "ingest", lambda *_, **x: 7 if waits else whole(*_, **x))
    assert collector.reconcile(book, str(logs), rounds=2, every=9, wait=waits.append) == 7
    assert waits == [9] and book.read("rollouts").head().thread_title == "A title" and len(events(book)) == 2


def test_copies_in_the_stream_are_decided(spark, logs, book, tmp_path):
    live = collector.LiveLedger(book)
    once = lambda: live.start(str(logs), checkpoint=f"file://{tmp_path}/checkpoint", once=True).awaitTermination(100)
    for d in ("a", "b"):
        write(logs / d / "rollout-x-1.jsonl", meta(id="r1"), count(1), count(2), count(3))
    once()
    assert [e[1] for e in events(book)] == [0, 1, 2] and book.read("rollouts").count() == 1
    assert sorted(r.canonical_status for r in book.read("source_files").collect()) == ["candidate", "canonical"]
    append(logs / "b" / "rollout-x-1.jsonl", count(4))  # the other copy goes on and takes over
    once()
    assert [e[1] for e in events(book)] == [0, 1, 2, 3]
    write(logs / "c" / "rollout-x-1.jsonl", meta(id="r1"), count(1))  # a shorter one changes nothing
    once()
    assert [e[1] for e in events(book)] == [0, 1, 2, 3] and book.read("source_files").count() == 3
    assert book.read("rollouts").head().canonical_source_path.endswith("/b/rollout-x-1.jsonl")


def test_a_session_with_many_copies(spark, logs, book):
    for i in range(3):
        write(logs / f"d{i}" / "rollout-x-1.jsonl", meta(id="r1"), *[count(k) for k in range(1, 2 + i)])
    write(logs / "z" / "rollout-x-2.jsonl", meta(id="r2"), count(1))
    collector.ingest(book, str(logs), now_ms=1)
    assert [e[:2] for e in events(book)] == [("r1", i) for i in range(3)] + [("r2", 0)]
    assert sorted(r.canonical_status for r in book.read("source_files").collect()) == ["candidate"] * 2 + ["canonical"] * 2


def test_relations_by_place(spark):
    def rows(key, *lists):
        out = [(k, i, 1, "m", v, 0, 0, 0) for k, x in lists for i, v in enumerate(x)]
        return spark.createDataFrame(out, f"{key} string, token_event_ordinal long, timestamp_epoch_ms long, model string, input_tokens long, cached_input_tokens long, output_tokens long, reasoning_output_tokens long")

    cases = {"equal": ([1, 2], [1, 2]), "extension": ([1], [1, 2]), "shorter": ([1, 2], [1]), "diverged": ([1], [2]), "fresh": ([], [1]), "gone": ([1], []), "none": ([], [])}
    files = spark.createDataFrame([(k, f"r-{k}") for k in cases], "path string, rollout_id string")
    new, old = rows("path", *((k, b) for k, (_, b) in cases.items())), rows("rollout_id", *((f"r-{k}", a) for k, (a, _) in cases.items()))
    got = {r.path: (r.identity_relation, r.semantic_relation, r.ledger_has_events) for r in canonical.relations(files, new, old).collect()}
    want = {"fresh": "extension", "gone": "shorter", "none": "equal"}
    assert got == {k: (want.get(k, k), want.get(k, k), bool(a)) for k, (a, _) in cases.items()}
    other = canonical.relations(files, new.withColumn("model", F.lit("x")), old).where("path = 'equal'").head()
    assert (other.identity_relation, other.semantic_relation) == ("equal", "diverged")


def test_session_titles(spark, tmp_path):
    path = tmp_path / "session_index.jsonl"
    entry = lambda i, name, at: f'{{"id":"{V7.format(i).upper()}","thread_name":"{name}","updated_at":"{at}"}}'
    path.write_bytes(b"\xef\xbb\xbf" + "\n".join([entry(1, "old", "2026-01-01T00:00:00Z"), entry(1, "tie a", "2026-02-01T00:00:00Z"), entry(1, " tie b ", "2026-02-01T00:00:00Z"), "junk", "", entry(2, "last line", "2026-01-01T00:00:00+08:00"), entry(3, "no zone", "2026-01-01T00:00:00")]).encode())
    titles, invalid = records.session_titles(spark, str(path))
    assert {r.conversation_id: r.title for r in titles.collect()} == {V7.format(1): "tie b", V7.format(2): "last line"} and invalid.head()[0] == 2
    titles, invalid = records.session_titles(spark, str(tmp_path / "missing"))
    assert titles.count() == 0 and invalid.head()[0] == 0


def run(live, logs, tmp_path):
    live.start(str(logs), checkpoint=f"file://{tmp_path}/checkpoint", once=False, every="0 seconds")


def test_stream_follows_growing_files(spark, logs, book, tmp_path):
    path = logs / "rollout-x-1.jsonl"
    write(path, meta(id="r1"), rec("event_msg", type="task_started", turn_id="t"), count(1), tail=count(2)[:20])
    live = collector.LiveLedger(book)

    def until(want):
        query = live.start(str(logs), checkpoint=f"file://{tmp_path}/checkpoint", every="0 seconds")
        try:
            end = time.time() + 60
            while events(book) != want and time.time() < end:
                time.sleep(0.3)
                if query.exception():
                    raise query.exception()
        finally:
            query.stop()
        assert events(book) == want

    until([("r1", 0, "unknown")])
    append(path, count(2)[20:])  # the partial line is completed
    until([("r1", 0, "unknown"), ("r1", 1, "unknown")])
    append(path, rec("turn_context", turn_id="t", model="late"))  # a model stated late reaches earlier events
    until([("r1", 0, "late"), ("r1", 1, "late")])
    write(path, meta(id="r1"), count(9))  # rewritten: read from its start
    until([("r1", 0, "unknown")])


def test_reader_reads_only_what_was_appended(logs):
    path = logs / "rollout-x-1.jsonl"
    write(path, *["x" * 1000] * 300)
    reader = GrowingFilesReader([str(logs)], 16)
    first = reader.latestOffset()
    assert sum(p.end - p.start for p in reader.partitions(reader.initialOffset(), first)) == path.stat().st_size
    append(path, "new", tail="rest")
    second = reader.latestOffset()
    (part,) = reader.partitions(first, second)
    facts, *lines = reader.read(part)
    assert facts[1] == -1 and b'"stable_length": 300304' in facts[2]
    assert [r[2] for r in lines] == [b"new"] and part.end - part.start == 4
    assert reader.partitions(second, reader.latestOffset()) == []
    for i in range(20):
        write(logs / f"rollout-y-{i:02d}.jsonl", "{}")
    third = reader.latestOffset()
    assert len(reader.partitions(second, third)) == 16
    for i in range(16):  # files that change again do not hold up those that wait
        append(logs / f"rollout-y-{i:02d}.jsonl", "{}")
    fourth = reader.latestOffset()
    assert {f"rollout-y-{i}.jsonl" for i in range(16, 20)} <= {os.path.basename(p.path) for p in reader.partitions(third, fourth)}
    path.unlink()
    assert "rollout-x-1" not in reader.latestOffset()["files"]
    write(path, "back")
    (part,) = (p for p in reader.partitions(fourth, reader.latestOffset()) if p.path == str(path))
    assert part.reset and part.start == 0


def test_many_files_at_once_and_after_a_restart(spark, logs, book, tmp_path):
    for i in range(40):
        write(logs / f"rollout-y-{i:02d}.jsonl", meta(id=f"r{i:02d}"), count(1))
    live, reader = collector.LiveLedger(book), GrowingFilesReader([str(logs)], 16)
    first = reader.latestOffset()
    assert len(reader.partitions(reader.initialOffset(), first)) == 40
    live.start(str(logs), checkpoint=f"file://{tmp_path}/checkpoint", once=True).awaitTermination(100)
    assert len(events(book)) == 40
    append(logs / "rollout-y-39.jsonl", count(2))
    again = GrowingFilesReader([str(logs)], 16)
    (part,) = again.partitions(first, again.latestOffset())
    assert part.path.endswith("y-39.jsonl") and part.start > 0 and not part.reset
    live.start(str(logs), checkpoint=f"file://{tmp_path}/checkpoint", once=True).awaitTermination(100)
    assert len(events(book)) == 41


def test_retries_wait_longer_each_time():
    waits, fails = [], iter([True, True, False])

    class Query:
        def awaitTermination(self):
            if next(fails):
                raise RuntimeError

    assert collector.with_retries(Query, sleep=waits.append) == 2 and waits == [0.25, 0.5]
    fails = iter([True] * 5)
    with pytest.raises(RuntimeError):
        collector.with_retries(Query, sleep=waits.append)
    assert waits[2:] == [0.25, 0.5, 1.0, 2.0]
    assert [collector.phase_after_inventory(*x) for x in ((False, True, 0), (True, True, 0), (True, True, 1), (True, False, 0))] == ["degraded", "watching", "partial", "partial"]
