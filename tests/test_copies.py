"""The fold over a session's files, rule by rule, without Spark; and inventories that need it."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import copies
from ledgerloom.operators.canonical import ATTRIBUTES
from ledgerloom.sources import logs as source
from ledgerloom.sources.ledger import Ledger
from ledgerloom.streaming import collector

from .test_collector import append, events, write
from .test_parser import count, meta

ATTRS = dict.fromkeys(ATTRIBUTES, "x") | {"is_realtime_voice": False}
DEFAULT = {"title": None, "activity": 0, "stable_length": 10, "size_bytes": 10, "modified_at_epoch_ms": 1, "boundary_hash": "h", "sure": True, "expected": True, "legacy": False, "target_free": False, "status": None, "present": None, "rewritten": False}


def prints(sequence, lengths):
    return [{"n": n, "i": str(sequence[:n]), "s": str(sequence[:n]) + "m"} for n in sorted(lengths) if 0 < n <= len(sequence)]


def session(*rows, rebuild=False):
    """rows: (kind, path, sequence, changes). Returns path -> (decision, status, taken) and what must be read again."""
    lengths = {len(r[2]) for r in rows}
    given = [DEFAULT | {"rollout_id": "r", "kind": k, "path": p, "n": len(s), "prints": prints(s, lengths), "attrs": ATTRS} | more for k, p, s, *rest in rows for more in [rest[0] if rest else {}]]
    random.Random(1).shuffle(given)
    out = copies.Session(given).decide(rebuild)
    needs = {r["path"]: r["needs"] for r in out if r.get("needs")}
    return needs or {r["path"]: (r["decision"], r["status"], r["taken"]) for r in out}


def known(path, status, present=True):
    return ("source", path, [], {"status": status, "present": present})


STORED, A = ("stored", "/a", [1, 2]), known("/a", "canonical")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        # copies of a session whose canonical file is /a with events 1, 2
        ([STORED, A, ("copy", "/b", [1, 2])], {"/b": ("candidate", "candidate", False)}),
        ([STORED, A, ("copy", "/b", [1])], {"/b": ("candidate", "candidate", False)}),
        ([STORED, A, ("copy", "/b", [1, 3])], {"/b": ("conflict", "conflict", False)}),
        ([STORED, A, ("copy", "/b", [1, 2, 3])], {"/b": ("promote", "canonical", True), "/a": ("replaced", "candidate", False)}),
        ([STORED, A, ("copy", "/b", [1, 2], {"attrs": ATTRS | {"agent_role": "other"}})], {"/b": ("conflict", "conflict", False)}),
        ([("stored", "/a", []), A, ("copy", "/b", [], {"attrs": ATTRS | {"agent_role": "other"}})], {"/b": ("candidate", "candidate", False)}),
        # the canonical file itself
        ([STORED, A, ("copy", "/a", [1, 2])], {"/a": ("promote", "canonical", True)}),
        ([STORED, A, ("copy", "/a", [1, 2, 3])], {"/a": ("promote", "canonical", True)}),
        ([STORED, A, ("copy", "/a", [1], {"sure": False})], {"/a": "confirm"}),
        ([STORED, A, ("copy", "/a", [1])], {"/a": ("confirm_and_replace", "canonical", True)}),
        ([STORED, A, ("copy", "/a", [7, 8, 9])], {"/a": ("confirm_and_replace", "canonical", True)}),
        ([STORED, A, ("copy", "/a", [1, 2], {"rewritten": True})], {"/a": ("confirm_and_replace", "canonical", True)}),
        ([STORED, A, ("copy", "/a", [1, 2], {"attrs": ATTRS | {"agent_role": "other"}})], {"/a": ("confirm_and_replace", "canonical", True)}),
        # a canonical file that is gone, and a session without one
        ([STORED, known("/a", "canonical", False), ("copy", "/b", [1, 2])], {"/b": ("promote", "canonical", True), "/a": ("replaced", "candidate", False)}),
        ([("stored", None, [1]), ("copy", "/b", [1])], {"/b": ("promote", "canonical", True)}),
        ([("copy", "/b", []), ("copy", "/c", [5])], {"/c": ("promote", "canonical", True), "/b": ("replaced", "candidate", False)}),
        # a conflict of another copy is no reason for an equal one to take over
        ([STORED, A, known("/b", "conflict"), ("copy", "/b", [1, 9]), ("copy", "/c", [1, 2])], {"/b": ("conflict", "conflict", False), "/c": ("candidate", "candidate", False)}),
        # a canonical file in conflict: extensions first, then length, time and path
        ([STORED, known("/a", "conflict"), ("copy", "/b", [1, 2])], {"/b": ("recover", "canonical", True), "/a": ("resolved", "candidate", False)}),
        ([STORED, known("/a", "conflict"), ("copy", "/b", [1, 2], {"sure": False})], {"/b": "fresh"}),
        ([STORED, known("/a", "conflict"), known("/c", "candidate"), ("copy", "/b", [1, 2])], {"/c": "seed"}),
        ([STORED, known("/a", "conflict"), ("copy", "/b", [1, 2]), ("copy", "/c", [1, 2, 3])], {"/c": ("recover", "canonical", True), "/b": ("candidate", "candidate", False), "/a": ("resolved", "candidate", False)}),
        ([STORED, known("/a", "conflict"), known("/c", "candidate"), ("seed", "/c", [1, 2], {"stable_length": 99}), ("copy", "/b", [1, 2])], {"/c": ("recover", "canonical", True), "/b": ("candidate", "candidate", False), "/a": ("resolved", "candidate", False)}),
        ([STORED, known("/a", "conflict"), ("copy", "/b", [1, 2]), ("copy", "/c", [1, 2], {"modified_at_epoch_ms": 2})], {"/c": ("recover", "canonical", True), "/b": ("candidate", "candidate", False), "/a": ("resolved", "candidate", False)}),
        ([STORED, known("/a", "conflict"), ("copy", "/b", [9])], {"/b": ("conflict", "conflict", False)}),
        # damaged records in the canonical file
        ([STORED, A, ("broken", "/a", [], {"sure": False})], {"/a": "confirm"}),
        ([STORED, A, ("broken", "/a", [])], {"/a": ("broken", "conflict", False)}),
        ([STORED, A, ("broken", "/a", []), known("/b", "candidate"), ("seed", "/b", [1, 2])], {"/a": ("resolved", "candidate", False), "/b": ("recover", "canonical", True)}),
        # another session in the canonical file
        ([STORED, A, ("moved", "/a", [])], {"/a": ("moved", "conflict", False)}),
        ([STORED, A, ("moved", "/a", []), known("/b", "candidate"), ("seed", "/b", [1, 2, 3])], {"/a": ("resolved", "candidate", False), "/b": ("recover", "canonical", True)}),
    ],
)
def test_decisions(rows, want):
    assert session(*rows) == want


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([STORED, A, ("copy", "/a", [7]), ("copy", "/b", [7, 8, 9])], {"/a": ("replaced", "candidate", False), "/b": ("promote", "canonical", True)}),
        ([STORED, A, ("copy", "/a", [7]), ("copy", "/b", [1, 2])], {"/a": ("replace", "canonical", True), "/b": ("conflict", "conflict", False)}),
        ([("copy", "/a", [7], {"stable_length": 1}), ("copy", "/b", [7], {"stable_length": 2})], {"/a": ("candidate", "candidate", False), "/b": ("replace", "canonical", True)}),
        ([("copy", "/a", [7], {"expected": False})], {"/a": ("reject", None, False)}),
        ([STORED, A, ("moved", "/a", [], {"legacy": True, "target_free": True})], {"/a": ("rekey", "canonical", False)}),
        ([STORED, A, ("moved", "/a", [], {"legacy": True, "target_free": True, "sure": False})], {"/a": "confirm"}),
        ([STORED, A, ("moved", "/a", [], {"legacy": True, "target_free": False})], {"/a": ("moved", "conflict", False)}),
        ([STORED, A, known("/b", "conflict"), ("moved", "/a", [], {"legacy": True, "target_free": True})], {"/b": "seed"}),
    ],
)
def test_rebuilds(rows, want):
    assert session(*rows, rebuild=True) == want


def test_prints_tell_relations(spark):
    rng = random.Random(4)
    lists = {f"/{i}": [rng.choice([1, 2]) for _ in range(rng.randrange(6))] for i in range(30)}
    rows = [(p, i, 1, "m", v, 0, 0, 0) for p, x in lists.items() for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "path string, token_event_ordinal long, timestamp_epoch_ms long, model string, input_tokens long, cached_input_tokens long, output_tokens long, reasoning_output_tokens long")
    lengths = spark.createDataFrame([(p, n) for p in lists for n in range(1, 6)], "path string, n long")
    got = {p: {"n": len(x), "prints": {}} for p, x in lists.items()}
    for r in copies.prints(table, "path", lengths).collect():
        got[r.path]["prints"] = {p.n: p.asDict() for p in r.prints}
    for a, x in lists.items():
        for b, y in lists.items():
            n = min(len(x), len(y))
            want = "diverged" if x[:n] != y[:n] else "equal" if len(x) == len(y) else "extension" if len(y) > len(x) else "shorter"
            assert copies.relation(got[a], got[b], "i") == copies.relation(got[a], got[b], "s") == want


# --- whole inventories ------------------------------------------------------------------------------------------------

OTHER = {"input_tokens": 99, "cached_input_tokens": 0, "output_tokens": 1, "reasoning_output_tokens": 0, "total_tokens": 100}


@pytest.fixture
def logs(tmp_path):
    return tmp_path / "logs"


@pytest.fixture
def book(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/ledger")


def status(book):
    return {os.path.basename(r.file_path)[8:-6]: (r.rollout_id, r.canonical_status) for r in book.read("source_files").collect()}


def test_conflicts_recover_and_lines_appended_meanwhile_are_not_lost(spark, logs, book, monkeypatch, tmp_path):
    path = lambda name: logs / f"rollout-{name}.jsonl"
    for s in ("equal", "longer", "apart", "moves", "gone", "race", "abc"):
        write(path(f"{s}-1"), meta(id=s), count(1), count(2))
    for s in ("equal", "moves", "gone"):
        write(path(f"{s}-2"), meta(id=s), count(1), count(2))
    whole = source.scan

    def slow(files, *size):  # a line is appended between the listing and the reading
        if path("race-1").read_text().count("\n") == 3:
            append(path("race-1"), count(3))
        return whole(files, *size)

    monkeypatch.setattr(source, "scan", slow)
    collector.ingest(book, str(logs), str(tmp_path / "no such root"), now_ms=1)
    monkeypatch.setattr(source, "scan", whole)
    assert status(book)["equal-2"] == ("equal", "candidate") and book.read("usage_events").where("rollout_id = 'race'").count() == 2
    for s in ("equal", "longer", "apart"):
        path(f"{s}-1").write_text("{not-json}\n")
    write(path("longer-2"), meta(id="longer"), count(1), count(2), count(3))
    write(path("apart-2"), meta(id="apart"), count(7, last=OTHER))
    write(path("moves-1"), meta(id="new"), count(4))
    path("gone-1").unlink()
    write(path("abc-2"), meta(id="abc"), count(1, last=OTHER), count(2))
    write(path("abc-3"), meta(id="abc"), count(1), count(2))
    collector.ingest(book, str(logs), now_ms=2)
    got = status(book)
    assert {k: v[1] for k, v in got.items() if v[1] != "canonical"} == {"equal-1": "candidate", "longer-1": "candidate", "apart-1": "conflict", "apart-2": "conflict", "gone-1": "candidate", "abc-2": "conflict", "abc-3": "candidate"}
    assert got["moves-1"] == ("new", "canonical") and got["moves-2"] == ("moves", "canonical")
    n = {r.rollout_id: r["count"] for r in book.read("usage_events").groupBy("rollout_id").count().collect()}
    assert n == {"equal": 2, "longer": 3, "apart": 2, "moves": 2, "new": 1, "gone": 2, "race": 3, "abc": 2}
    paths = {r.rollout_id: os.path.basename(r.canonical_source_path) for r in book.read("rollouts").collect()}
    assert paths["gone"] == "rollout-gone-2.jsonl" and paths["abc"] == "rollout-abc-1.jsonl"
    state = {r.key: r.value for r in book.read("collector_state").collect()}
    assert state["phase"] == "partial" and state["usage_revision"] == "2" and "last_inventory" in state
    assert book.read("rollout_checkpoints").count() == 7  # none for a canonical file in conflict
    told = {(os.path.basename(r.file_path)[8:-6], r.details_json) for r in book.read("collector_diagnostics").where("code = 'source_conflict'").collect()}
    assert {"apart-1", "apart-2", "abc-2"} <= {x for x, _ in told}
    before = book.read("collector_diagnostics").count()
    collector.ingest(book, str(logs), now_ms=3)  # conflicts are tried again and not reported twice
    assert status(book) == got and book.read("collector_diagnostics").count() == before


def test_a_commit_writes_the_buckets_of_its_sessions(spark, logs, book, tmp_path):
    for i in range(40):
        write(logs / f"rollout-x-{i}.jsonl", meta(id=f"r{i}"), count(1))
    collector.ingest(book, str(logs), now_ms=1)
    before = {t: book.folders(t) for t in ("usage_events", "rollouts", "source_files")}
    append(logs / "rollout-x-7.jsonl", count(2))
    collector.ingest(book, str(logs), now_ms=2)
    for t, folders in before.items():
        changed = {b for b, f in book.folders(t).items() if f != folders.get(b)}
        assert len(changed) == 1 and len(folders) > 20
    assert len(events(book)) == 41
    old = Ledger(spark, book.root)
    assert old.buckets == book.buckets and old.read("usage_events", revision=2).count() == 40
    assert old.read("rollouts", buckets=[]).count() == 0
    assert book.vacuum(keep=1) > 0 and len(events(Ledger(spark, book.root))) == 41


def test_legacy_ids_are_renamed_in_a_rebuild(spark, logs, book, monkeypatch):
    new = "01990000-0000-7000-8000-000000000001"
    path = logs / f"rollout-2026-07-31T15-23-09-{new}.jsonl"
    old = f"07-31T15-23-09-{new}"
    write(path, meta(id=old), count(1))
    collector.ingest(book, str(logs), now_ms=1)
    assert [e[0] for e in events(book)] == [old]
    write(path, meta(id=new), count(1), count(2))
    collector.ingest(book, str(logs), rebuild=True, now_ms=2)
    assert [e[0] for e in events(book)] == [new, new] and {r.rollout_id for r in book.read("source_files").collect()} == {new}
    assert [r.rollout_id for r in book.read("rollouts").collect()] == [new]


def test_older_ledgers_get_defaults(spark, tmp_path):
    from ledgerloom import schema

    columns = [f.name for f in schema.struct(schema.ROLLOUTS) if f.name not in ("project_name", "thread_title", "last_activity_epoch_ms")]
    row = spark.createDataFrame([("r", "c", "", "main", "main", "/root", "", None, None, None, None, 1, 1)], schema.struct(schema.ROLLOUTS.replace("thread_title string, last_activity_epoch_ms long", "thread_title string"))).select(*columns)
    row.write.parquet(f"{tmp_path}/l/tables/rollouts-v4-x")
    got = schema.upgraded(spark, "rollouts", schema.version_of("tables/rollouts-v4-x"), [f"{tmp_path}/l/tables/rollouts-v4-x"]).head()
    assert (got.project_name, got.thread_title, got.last_activity_epoch_ms, got.rollout_id) == ("Codex", "", 0, "r")
    assert schema.version_of("tables/rollouts-abc/bucket=3") == schema.VERSION


def test_index_of_titles_is_bounded_and_stable(spark, tmp_path, monkeypatch):
    from ledgerloom.sources import records

    index = tmp_path / "index.jsonl"
    index.write_text('{"id":"01990000-0000-7000-8000-000000000001","thread_name":"A","updated_at":"2026-01-01T00:00:00Z"}\nno\n')
    titles, invalid = records.stable_titles(spark, str(index))
    assert [r.title for r in titles.collect()] == ["A"] and invalid == 1
    titles, invalid = records.stable_titles(spark, str(tmp_path / "none"))
    assert titles.count() == 0 and invalid == 0
    monkeypatch.setattr(records, "MOST_INDEX_BYTES", 10)
    with pytest.raises(records.UnstableIndex):
        records.stable_titles(spark, str(index))
    monkeypatch.undo()
    sizes = iter([(5, 1), (6, 1)])
    monkeypatch.setattr(source, "facts_of_file", lambda _: next(sizes))
    with pytest.raises(records.UnstableIndex):
        records.stable_titles(spark, str(index))


def test_phases():
    phases = collector.Phases()
    event = type("E", (), {"exception": "x", "progress": type("P", (), {"numInputRows": 0, "batchId": 1})})
    seen = []
    for step in (lambda: phases.onQueryStarted(event), lambda: phases.onQueryProgress(event), lambda: phases.onQueryTerminated(event), phases.waits, lambda: phases.onQueryTerminated(event), lambda: phases.onQueryStarted(event), lambda: phases.onQueryIdle(event), phases.gave_up):
        step()
        seen.append(phases.phase)
    assert seen == ["syncing", "watching", "degraded", "retrying", "retrying", "retrying", "watching", "degraded"]


def test_many_copies_take_no_more_jobs(spark):
    """A fold over a session with 200 copies, each longer than the one before."""
    rows = spark.range(200).selectExpr(
        "'r' AS rollout_id", "'copy' AS kind", "concat('/', lpad(id, 4, '0')) AS path", "id AS n", "transform(sequence(0L, id), k -> named_struct('n', k, 'i', string(k), 's', string(k))) AS prints",
        f"named_struct({', '.join(repr(a) + ', ' + ('false' if a == 'is_realtime_voice' else repr('x')) for a in ATTRIBUTES)}) AS attrs", "CAST(NULL AS string) AS title", "0L AS activity", "id AS stable_length", "id AS size_bytes", "1L AS modified_at_epoch_ms", "'h' AS boundary_hash",
        "true AS sure", "true AS expected", "false AS legacy", "false AS target_free", "CAST(NULL AS string) AS status", "CAST(NULL AS boolean) AS present", "false AS rewritten",
    )
    got = {r.path: (r.status, r.taken) for r in copies.fold(rows).collect()}
    assert got["/0199"] == ("canonical", True) and sum(s == "candidate" for s, _ in got.values()) == 199
