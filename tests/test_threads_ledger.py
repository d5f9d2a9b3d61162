"""Thread closures, ledger snapshots and their state transitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.operators import canonical, mutations, threads
from ledgerloom.sources import ledger as ledger_module
from ledgerloom.sources.ledger import Ledger
from ledgerloom.sources.paths import ProtectedPath, assert_writable

A, B, C = (f"0190000{i}-0000-7000-8000-000000000000" for i in "123")


def rollout(spark, *rows):
    base = {"rollout_id": "r", "conversation_id": A, "parent_thread_id": "", "thread_type": "main", "agent_role": "main", "agent_path": "/root", "agent_nickname": "", "is_realtime_voice": False, "project_name": "p", "thread_title": "", "last_activity_epoch_ms": 5, "canonical_source_path": None, "created_at_epoch_ms": 1, "updated_at_epoch_ms": 1}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema.ROLLOUTS)


def event(spark, *rows):
    base = {"rollout_id": "r", "token_event_ordinal": 0, "timestamp_epoch_ms": 1, "model": "m", "input_tokens": 2, "cached_input_tokens": 1, "output_tokens": 2, "reasoning_output_tokens": 1, "event_signature": "s"}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema.EVENTS)


def source(spark, *rows):
    base = {"file_path": "/a", "rollout_id": "r", "size_bytes": 10, "modified_at_epoch_ms": 1, "byte_offset": 10, "prefix_hash": "h", "prefix_status": "verified", "canonical_status": "canonical", "is_present": True, "last_scanned_at_epoch_ms": 1, "last_error": None}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema.SOURCES)


def test_closure_takes_the_whole_tree_and_ends_on_cycles(spark):
    sub = {"thread_type": "subagent", "conversation_id": B}
    rows = rollout(
        spark, {"rollout_id": "m"}, sub | {"rollout_id": "c", "parent_thread_id": A}, sub | {"rollout_id": "n", "parent_thread_id": "c"}, sub | {"rollout_id": "x", "parent_thread_id": "y"}, sub | {"rollout_id": "y", "parent_thread_id": "x"},
        sub | {"rollout_id": "no", "parent_thread_id": B}, sub | {"rollout_id": "m2", "parent_thread_id": "n", "conversation_id": C},
    )
    assert {r[0] for r in threads.thread_closure(rows, A).collect()} == {"m", "c", "n", "m2"}
    assert threads.thread_closure(rows, "not-an-id").count() == 0
    assert {r[1] for r in threads.closure(rows, spark.createDataFrame([("x", "x")], "root string, rollout_id string")).collect()} == {"x", "y"}
    events = event(spark, {"rollout_id": "n"}, {"rollout_id": "x"})
    assert [r.rollout_id for r in threads.events_of_thread(events, rows, A).collect()] == ["n"]


def test_the_children_of_a_conversation_are_met_once_not_by_each_of_its_main_threads(spark):
    """400 main threads of one conversation and 400 children of it: the jobs write a row or two a rollout, not one a pair."""
    n = 400
    child = {"thread_type": "subagent", "conversation_id": B, "parent_thread_id": A}
    rows = rollout(spark, *[{"rollout_id": f"m{i}"} for i in range(n)], *[child | {"rollout_id": f"c{i}"} for i in range(n)])
    written = []
    real = threads.cut
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(threads, "cut", lambda df: written.append(real(df)) or written[-1])
        found = threads.closure(rows, threads.main_roots(rows))
    assert {tuple(r) for r in found.collect()} == {(A, f"{kind}{i}") for kind in "mc" for i in range(n)} and found.count() == 2 * n
    assert max(x.count() for x in written) <= 3 * n


def test_a_root_that_is_no_rollout_is_alone_and_names_of_both_kinds_keep_apart(spark):
    sub = {"thread_type": "subagent", "conversation_id": C}
    rows = rollout(spark, {"rollout_id": "m"}, sub | {"rollout_id": "c", "parent_thread_id": A}, sub | {"rollout_id": A, "parent_thread_id": "elsewhere"}, sub | {"rollout_id": "g", "parent_thread_id": "gone"})
    roots = spark.createDataFrame([("1", "m"), ("2", "gone"), ("3", A)], "root string, rollout_id string")
    assert {tuple(r) for r in threads.closure(rows, roots).collect()} == {("1", "m"), ("1", "c"), ("2", "gone"), ("3", A), ("3", "c")}


def test_recent_threads(spark):
    rows = rollout(
        spark, {"rollout_id": "a", "last_activity_epoch_ms": 1}, {"rollout_id": "b", "conversation_id": B, "last_activity_epoch_ms": 2}, {"rollout_id": "v", "conversation_id": C, "is_realtime_voice": True, "last_activity_epoch_ms": 99},
        {"rollout_id": "l", "conversation_id": "legacy", "last_activity_epoch_ms": 98}, {"rollout_id": "s", "thread_type": "subagent", "parent_thread_id": "a", "conversation_id": "x", "last_activity_epoch_ms": 50},
        {"rollout_id": "bv", "conversation_id": B, "is_realtime_voice": True, "last_activity_epoch_ms": 60},
    )
    assert [(r.conversation_id, r.last_activity_epoch_ms) for r in threads.recent_main_threads(rows, 2).collect()] == [(B, 60), (A, 50)]
    assert threads.recent_main_threads(rows, 1).count() == 1


def test_append_is_idempotent_and_conflicts_fail(spark):
    old = event(spark, {}, {"token_event_ordinal": 1})
    table, counts = mutations.append_events(old, event(spark, {"token_event_ordinal": 1}, {"token_event_ordinal": 2}))
    assert table.count() == 3 and tuple(counts.head()) == (1, 1)
    with pytest.raises(Exception, match="conflicting usage event at r:1"):
        mutations.append_events(old, event(spark, {"token_event_ordinal": 1, "event_signature": "other"}))[0].collect()
    for bad in ({"cached_input_tokens": 9}, {"reasoning_output_tokens": 9}, {"timestamp_epoch_ms": -1}, {"model": ""}, {"event_signature": None}):
        with pytest.raises(Exception, match="invalid event"):
            mutations.append_events(old, event(spark, {"token_event_ordinal": 7} | bad))[0].collect()


def test_replace_and_upsert(spark):
    table = mutations.replace_events(event(spark, {}, {"rollout_id": "q"}), event(spark, {"model": "new"}), rollout(spark, {}))
    assert sorted((r.rollout_id, r.model) for r in table.collect()) == [("q", "m"), ("r", "new")]
    old = rollout(spark, {"last_activity_epoch_ms": 9, "canonical_source_path": "/a"})
    new = mutations.upsert_rollouts(old, rollout(spark, {"last_activity_epoch_ms": 3, "project_name": "new"}, {"rollout_id": "q"}), 77).orderBy("rollout_id").collect()
    assert [(r.rollout_id, r.project_name, r.last_activity_epoch_ms, r.canonical_source_path, r.created_at_epoch_ms, r.updated_at_epoch_ms) for r in new] == [("q", "p", 5, None, 77, 77), ("r", "new", 9, "/a", 1, 77)]


def test_promotion_swaps_canonical_sources(spark):
    sources = source(spark, {}, {"file_path": "/b", "canonical_status": "candidate"}, {"file_path": "/c", "canonical_status": "conflict", "last_error": "x"})
    checkpoints = spark.createDataFrame([("/a", "r"), ("/b", "r")], "file_path string, rollout_id string")
    chosen = spark.createDataFrame([("r", "/b", "/c")], "rollout_id string, path string, resolved string")
    rollouts, after, left = mutations.promote(rollout(spark, {}), sources, checkpoints, chosen, 42)
    assert rollouts.head().canonical_source_path == "/b"
    assert {r.file_path: (r.canonical_status, r.last_error) for r in after.collect()} == {"/a": ("candidate", None), "/b": ("canonical", None), "/c": ("candidate", None)}
    assert [r.file_path for r in left.collect()] == ["/b"]
    with pytest.raises(mutations.Conflict):
        mutations.promote(rollout(spark, {}), sources, checkpoints, chosen.withColumn("path", F.lit("/zzz")), 42)


def test_missing_sources_keep_history(spark):
    sources = source(spark, {}, {"file_path": "/b"})
    gone = mutations.missing_sources(sources, spark.createDataFrame([("/b",)], "file_path string"))
    after, left = mutations.mark_missing(sources, spark.createDataFrame([("/a",)], "file_path string"), gone, 9)
    assert {r.file_path: r.is_present for r in after.collect()} == {"/a": False, "/b": True} and left.count() == 0


def test_titles(spark):
    rows = rollout(spark, {"thread_title": "old"}, {"rollout_id": "q", "conversation_id": B, "thread_title": "stays"})
    titles = spark.createDataFrame([(A, "new")], "conversation_id string, title string")
    table, changed = mutations.synchronise_titles(rows, titles, authoritative=False)
    assert changed and {r.rollout_id: r.thread_title for r in table.collect()} == {"r": "new", "q": "stays"}
    table, _ = mutations.synchronise_titles(rows, titles, authoritative=True)
    assert {r.rollout_id: r.thread_title for r in table.collect()} == {"r": "new", "q": ""}
    assert not mutations.synchronise_titles(table, titles, authoritative=True)[1]


def test_runs_and_state(spark):
    runs = spark.createDataFrame([("a", "start", "running", 1, 5, None, 0, 0, None), ("b", "timer", "completed", 10, None, 20, 0, 0, None)], schema.RUNS)
    done = mutations.finish_run(mutations.heartbeat(runs, "a", 7), "a", 8, "completed")
    assert done.where("run_id = 'a'").head().completed_at_epoch_ms == 8 and mutations.latest_run(runs).head().run_id == "b"
    with pytest.raises(mutations.Conflict):
        mutations.finish_run(runs, "b", 9, "failed")
    assert [tuple(r) for r in mutations.observation_gaps(done).collect()] == [("b", 8, 10)]
    state = mutations.put_state(spark.createDataFrame([("k", "1", 1)], schema.STATE), spark.createDataFrame([("k", "2", 2), ("j", "3", 2)], schema.STATE))
    assert {r.key: r.value for r in state.collect()} == {"k": "2", "j": "3"}


def test_rekey(spark):
    tables = {"rollouts": rollout(spark, {}), "usage_events": event(spark, {}), "source_files": source(spark, {}), "rollout_checkpoints": spark.createDataFrame([("/a", "r")], "file_path string, rollout_id string")}
    assert all(t.head().rollout_id == A for t in mutations.rekey(tables, "r", A).values())
    with pytest.raises(mutations.Conflict):
        mutations.rekey(tables, "r", "r")


@pytest.mark.parametrize("old,new,relation", [([1, 2], [1, 2], "equal"), ([1], [1, 2], "extension"), ([1, 2], [1], "shorter"), ([1], [2], "diverged"), ([], [1], "extension"), ([], [], "equal")])
def test_sequence_relation(spark, old, new, relation):
    row = spark.createDataFrame([(old, new)], "a array<int>, b array<int>")
    assert row.select(canonical.sequence_relation(F.col("a"), F.col("b"))).head()[0] == relation


def test_decision_table(spark):
    base = {"rebuild": False, "expected_id_matches": True, "is_canonical": False, "has_canonical": True, "canonical_present": True, "canonical_in_conflict": False, "recoverable": False, "prefix_rewritten": False, "identity_relation": "equal", "semantic_relation": "equal", "same_metadata": True, "ledger_has_events": True}
    cases = [
        ({}, "candidate"), ({"rebuild": True}, "replace"), ({"rebuild": True, "expected_id_matches": False}, "reject"), ({"canonical_in_conflict": True, "recoverable": True}, "recover"), ({"is_canonical": True, "prefix_rewritten": True}, "confirm_and_replace"),
        ({"is_canonical": True, "identity_relation": "shorter"}, "confirm_and_replace"), ({"identity_relation": "diverged"}, "conflict"), ({"identity_relation": "shorter"}, "candidate"), ({"same_metadata": False}, "conflict"),
        ({"identity_relation": "extension", "semantic_relation": "extension"}, "promote"), ({"has_canonical": False}, "promote"), ({"canonical_present": False}, "promote"), ({"is_canonical": True}, "promote"),
    ]
    rows = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], list(base))
    assert [r.d for r in rows.select(canonical.decision().alias("d")).collect()] == [d for _, d in cases]


def test_ledger_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    book = Ledger(spark, root)
    assert book.revision == 0 and book.read("rollouts").count() == 0
    book.commit(rollouts=rollout(spark, {}), usage_events=event(spark, {}))
    old = book.read("usage_events")
    book.commit(usage_events=event(spark, {}, {"token_event_ordinal": 1}))
    assert book.revision == 2 and old.count() == 1 and book.read("usage_events").count() == 2 and book.read("rollouts").count() == 1
    again = Ledger(spark, root)
    assert again.revision == 2 and again.read("usage_events", revision=1).count() == 1
    book.commit(rollouts=rollout(spark, {}))
    with pytest.raises(RuntimeError):
        again.commit(rollouts=rollout(spark, {}))
    with pytest.raises(Exception, match="invalid event"):  # a failed write publishes nothing
        book.commit(usage_events=mutations.append_events(book.read("usage_events"), event(spark, {"model": ""}))[0])
    assert Ledger(spark, root).revision == 3


def test_newer_ledgers_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(schema, "VERSION", 8)
    Ledger(spark, f"file://{tmp_path}/l").commit(rollouts=rollout(spark, {}))
    monkeypatch.setattr(schema, "VERSION", 7)
    with pytest.raises(ValueError):
        Ledger(spark, f"file://{tmp_path}/l")


def test_copies_and_paths(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d / "x").mkdir(parents=True)
        (tmp_path / d / "x" / "f").write_text("same")
    (tmp_path / "a" / "g").write_text("1")
    (tmp_path / "b" / "g").write_text("2")
    assert [r.name for r in ledger_module.differing_copies(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()] == ["g"]
    with pytest.raises(ProtectedPath):
        assert_writable(str(tmp_path / "a" / "new"), str(tmp_path / "a"))
    (tmp_path / "link").symlink_to(tmp_path / "a")
    with pytest.raises(ProtectedPath):
        assert_writable(str(tmp_path / "link" / "y"), str(tmp_path / "a"))
    assert assert_writable(str(tmp_path / "c"), str(tmp_path / "a"))
