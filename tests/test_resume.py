"""Attribution that goes on from a checkpoint, against reading whole files; and a stream that uses it."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom.operators import attribution, resume
from ledgerloom.sources import records
from ledgerloom.sources.ledger import Ledger
from ledgerloom.streaming import collector

from .test_collector import append, events, write
from .test_parser import count, files, meta, rec

EVENT = ("path", "timestamp", "timestamp_epoch_ms", "token_event_ordinal", "turn_id", "model", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "event_signature")


def random_log(rng):
    turns, models = ["t1", "t2", "t3"], ["m1", "m2"]
    lines = [meta(id="r", **rng.choice([{}, {}, {"thread_source": "realtime_voice"}]))] if rng.random() < 0.9 else []
    for k in range(rng.randrange(4, 30)):
        turn = rng.choice(turns)
        lines.append(
            rng.choice(
                [
                    rec("turn_context", turn_id=turn, model=rng.choice(models)), rec("turn_context", turn_id=turn), rec("event_msg", type="task_started", turn_id=turn), rec("event_msg", type="task_complete", turn_id=turn), rec("event_msg", type="task_complete"),
                    rec("event_msg", type="thread_settings_applied", thread_settings={"model": rng.choice(["s1", "unknown"])}), count(rng.randrange(5)), count(k), count(k, turn_id=turn), rec("note"), "",
                    count(k, last={"input_tokens": 1, "cached_input_tokens": 2, "output_tokens": 0, "reasoning_output_tokens": 0, "total_tokens": 1}), rec("event_msg", ts="bad", type="token_count", info={}), "[]" if rng.random() < 0.1 else "",
                ]
            )
        )
    return lines


def test_resuming_equals_reading_all(spark):
    rng = random.Random(8)
    whole = [random_log(rng) for _ in range(150)]
    cuts = [rng.randrange(1, len(x)) for x in whole]
    first = attribution.parse(files(spark, *[x[:c] for x, c in zip(whole, cuts, strict=True)]))
    states = first["states"]
    name = "rollout-2026-x-{}.jsonl"
    at = spark.createDataFrame([(name.format(i), c) for i, c in enumerate(cuts)], "path string, at long")
    rows = files(spark, *whole)
    rest = rows.join(at, "path").where("line >= at").drop("at")
    got = resume.resumed(rest, states.join(at, "path")).collect()
    asked = {r.path: r.whole for r in got if r.whole}
    ends = {r.path: r.state for r in got if r.state}
    all_ = attribution.parse(rows)
    want = {}
    for r in all_["events"].select(*EVENT).collect():
        want.setdefault(r.path, []).append(tuple(r))
    before = {}
    for r in first["events"].select(*EVENT).collect():
        before.setdefault(r.path, []).append(tuple(r))
    for r in got:
        if r.token_event_ordinal is not None and r.path in ends:
            before.setdefault(r.path, []).append(tuple(r[c] for c in EVENT))
    assert len(ends) > 60 and len(asked) > 10 and {"late model", "non_object"} <= set(asked.values())
    for path in ends:
        assert sorted(before.get(path, []), key=lambda e: e[3]) == sorted(want.get(path, []), key=lambda e: e[3]), path
    final = {r.path: r.state for r in all_["states"].collect()}
    import json

    assert all(json.loads(ends[p]) == {"last_set": None, "snapshot": None} | json.loads(final[p]) | {"turns": [{"model": None} | t for t in json.loads(final[p])["turns"]]} for p in ends)


def test_an_appended_line_reads_no_file_and_writes_one_bucket(spark, tmp_path, monkeypatch):
    logs, book = tmp_path / "logs", Ledger(spark, f"file://{tmp_path}/ledger")
    for i in range(30):
        write(logs / f"rollout-x-{i:02d}.jsonl", meta(id=f"r{i:02d}"), rec("turn_context", turn_id="t", model="m"), count(1))
    told = []
    live = collector.LiveLedger(book, told.append)
    once = lambda: live.start(str(logs), checkpoint=f"file://{tmp_path}/checkpoint", once=True).awaitTermination(200)
    once()
    assert len(events(book)) == 30 and len(told) == 1
    whole, read, folders = collector.read_files, [], book.folders("usage_events")
    monkeypatch.setattr(collector, "read_files", lambda f: read.append(sorted(r.file_path for r in f.collect())) or whole(f))
    append(logs / "rollout-x-07.jsonl", count(2), count(3))
    once()
    assert [e for e in events(book) if e[0] == "r07"] == [("r07", i, "m") for i in range(3)] and read == [] and len(told) == 2
    assert sum(book.folders("usage_events")[b] != f for b, f in folders.items()) == 1
    source = book.read("source_files").where("rollout_id = 'r07'").head()
    assert source.byte_offset == (logs / "rollout-x-07.jsonl").stat().st_size
    append(logs / "rollout-x-07.jsonl", rec("turn_context", turn_id="t", model="late"))  # earlier events change: read as a whole
    (logs / "rollout-x-08.jsonl").unlink()
    append(logs / "rollout-x-09.jsonl", "not-json")
    write(logs / "copy" / "rollout-x-10.jsonl", meta(id="r10"), rec("turn_context", turn_id="t", model="m"), count(1), count(2))
    once()
    assert [e for e in events(book) if e[0] == "r07"] == [("r07", i, "late") for i in range(3)] and [e for e in events(book) if e[0] == "r10"] == [("r10", i, "m") for i in range(2)]
    status = {r.rollout_id: (r.canonical_status, r.is_present) for r in book.read("source_files").where("rollout_id <> 'r10'").collect()}
    assert status["r08"] == ("canonical", False) and status["r09"] == ("conflict", True) and len(events(book)) == 33
    assert {r.details_json for r in book.read("collector_diagnostics").collect()} == {'{"reason":"canonical-source-malformed"}'}
    live.finish()
    run = book.read("collector_runs").head()
    assert (run.trigger, run.status) == ("stream", "completed") and book.read("rollout_checkpoints").where(F.col("state_json").isNotNull()).count() == 28


def test_a_state_goes_ahead_of_its_records_once(spark):
    state = '{"turn":"","overridden":false,"model":"unknown","ordinal":0,"voice":false,"turns":[]}'
    held = spark.createDataFrame([("a", state), ("idle", state)], "path string, state string")
    rows = records.typed(spark.createDataFrame([("a", 3, "{}"), ("stateless", 0, "{}")], "path string, line long, raw string"))
    got = resume.resumed(rows, held)
    assert [r.path for r in got.collect() if r.state is not None] == ["a"]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
