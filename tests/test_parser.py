"""Records, attribution and replay gates: constants, and windows against a sequential reading of the same rules."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import attribution
from ledgerloom.sources import records

T0 = "2026-07-15T01:02:03.004Z"
TURN = "0199000{}-0000-7000-8000-000000000000"


def usage(i=10, c=1, o=4, r=1):
    return {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r, "total_tokens": i + o}


def rec(kind, ts=T0, **payload):
    return json.dumps({"timestamp": ts, "type": kind, "payload": payload})


def count(total, last=None, **more):
    return rec("event_msg", type="token_count", info={"last_token_usage": last or usage(), "total_token_usage": usage(total)}, **more)


def meta(**more):
    return rec("session_meta", **({"session_id": "conv", "id": "roll", "cwd": "/home/u/proj"} | more))


def files(spark, *contents, name="rollout-2026-x-{}.jsonl"):
    rows = [(name.format(i), c if isinstance(c, bytes) else ("\n".join(c) + "\n").encode()) for i, c in enumerate(contents)]
    return records.records(spark.createDataFrame(rows, "path string, content binary"))


def parsed(spark, *lines):
    return attribution.parse(files(spark, list(lines)))


def models(spark, *lines):
    return [r.model for r in parsed(spark, *lines)["events"].orderBy("token_event_ordinal").collect()]


def test_bad_lines(spark):
    bad = dict(usage())
    del bad["total_tokens"]
    lines = ["", "not-json", "[]", count(1, last=bad), count(2, last=usage() | {"input_tokens": -1}), count(3, last=usage() | {"input_tokens": 1.5}), count(4, last=usage(1, 2)), count(5, last=usage(5, 1, 1, 2)), count(6, last=usage(0, 0, 0, 0))]
    rows = files(spark, lines)
    assert {r["class"]: r["count"] for r in rows.groupBy("class").count().collect()} == {"blank": 1, "malformed": 1, "non_object": 1, "object": 6}
    out = attribution.parse(rows)
    assert {r.drop_reason: r["count"] for r in out["drops"].collect()} == {"invalid_usage": 3, "invalid_relation": 2, "zero_breakdown": 1} and out["events"].count() == 0
    assert [r.path for r in records.damaged_files(rows).collect()] == ["rollout-2026-x-0.jsonl"]
    assert records.class_counts(rows).head()["malformed"] == 1


@pytest.mark.parametrize("raw,kind", [
    (b"", "blank"), (b" \t\r", "blank"), ("\u00a0\u2003".encode(), "blank"), (b"\0\0\0", "null_padding"), (b'{"a":1} x', "malformed"), (b'{"a":NaN}', "malformed"), (b'{"a":1}', "object"), (b"3", "non_object"), (b"\xff\xfe", "malformed"),
    (b"[" * 70 + b"]" * 70, "malformed"), (b'{"type":"a","type":"b"}', "object"),
])
def test_record_classes(raw, kind):
    assert records.classified(raw)[0] == kind


@pytest.mark.parametrize("root,kind", [
    ({"type": "response_item", "payload": {"type": "message"}}, "oversized_opaque"), ({"type": "compacted"}, "oversized_opaque"), ({"type": "event_msg", "payload": {"type": "mcp_tool_call_end"}}, "oversized_opaque"),
    ({"type": "event_msg", "payload": {"type": "token_count"}}, "oversized_critical"), ({"type": "session_meta", "payload": {}}, "oversized_critical"), ({"type": "response_item", "payload": {"type": "agent_message"}}, "oversized_critical"),
    ({"type": "response_item", "payload": {"type": "odd"}}, "oversized_unclassified"), ({"type": "response_item", "payload": 3}, "oversized_unclassified"), ({"type": "odd"}, "oversized_unclassified"),
])
def test_oversized_records(root, kind):
    raw = json.dumps(root | {"filler": "x" * records.MOST_RECORD_BYTES}).encode()
    assert records.classified(raw)[0] == kind
    assert records.classified(raw[:-1])[0] == "malformed"
    twice = raw[:-1] + b',"type":"compacted"}'
    assert records.classified(twice)[0] == "oversized_unclassified"


def test_partial_tail_and_carriage_returns(spark):
    rows = files(spark, (meta() + "\r\n" + count(1) + "\r\n" + count(2)).encode()).collect()
    assert [r.line for r in rows] == [0, 1] and rows[1]["class"] == "object"


def test_settings_and_contexts(spark):
    lines = [
        meta(), rec("event_msg", type="thread_settings_applied", thread_settings={"model": "gpt-current"}), count(1), rec("turn_context", turn_id="t1", model="gpt-a"), rec("event_msg", type="thread_settings_applied", thread_settings={"model": "gpt-current"}),
        count(2), rec("turn_context", turn_id="t2", model="gpt-b"), count(3),
    ]
    assert models(spark, *lines) == ["gpt-current", "gpt-current", "gpt-b"]


def test_late_model_and_unknown(spark):
    out = parsed(spark, meta(), rec("event_msg", type="task_started", turn_id="t1"), count(1), rec("event_msg", type="task_started", turn_id="t2"), count(2), rec("turn_context", turn_id="t1", model="late"))
    assert [r.model for r in out["events"].orderBy("token_event_ordinal").collect()] == ["late", "unknown"]
    assert [tuple(r) for r in out["turns"].select("turn_id", "unresolved", "provisional").collect()] == [("t2", True, False)]


def test_adjacent_snapshots(spark):
    out = parsed(spark, count(1), count(1), count(2), count(1), count(9, last=usage(0, 0, 0, 0)), count(1))
    assert out["events"].count() == 3 and {r.drop_reason: r["count"] for r in out["drops"].collect()} == {"duplicate_snapshot": 2, "zero_breakdown": 1}


def test_metadata(spark):
    spawn = {"subagent": {"thread_spawn": {"parent_thread_id": "p", "agent_role": "worker"}}}
    rows = files(spark, [meta(source=spawn, agent_path="/root/w", agent_nickname="nick"), meta(id="second")], [meta(thread_source="realtime_voice", cwd="C:\\a\\b\\")], [meta(thread_source="odd", id=None, session_id=None)], [count(1)])
    got = {r.path[-7]: r for r in records.metadata(rows).collect()}
    a, b, c, d = (got[str(i)] for i in range(4))
    assert (a.thread_type, a.agent_role, a.agent_path, a.parent_thread_id, a.agent_nickname, a.rollout_id, a.project_name) == ("subagent", "worker", "/root/w", "p", "nick", "roll", "proj")
    assert (b.thread_type, b.agent_role, b.agent_path, b.is_realtime_voice, b.project_name) == ("main", "main", "/root", True, "b")
    assert (c.thread_type, c.agent_role, c.rollout_id, c.conversation_id) == ("unknown", "unknown", "x-2", "x-2") and d.rollout_id == "x-3"
    assert a.last_activity_epoch_ms == 1784077323004
    assert attribution.parse(files(spark, [count(1), meta(thread_source="realtime_voice"), count(2)]))["events"].count() == 0


def test_main_fork_opens_with_the_first_live_task(spark):
    at = 1784077323
    old, new = rec("event_msg", type="task_started", turn_id="a", started_at=at - 5), rec("event_msg", type="task_started", turn_id="b", started_at=at + 5)
    lines = [meta(forked_from_id="f"), rec("turn_context", turn_id="a", model="gpt-old"), old, count(1), count(2), new, rec("turn_context", turn_id="b", model="gpt-new"), count(3), count(4)]
    assert models(spark, *lines) == ["gpt-new", "gpt-new"]
    assert models(spark, *lines[:5]) == []
    assert models(spark, meta(forked_from_id="f", thread_source="odd"), new, count(3)) == []


def test_subagent_fork_needs_confirmation(spark):
    m = meta(forked_from_id="f", thread_source="subagent", agent_path="/root/w")
    start, context = rec("event_msg", type="task_started", turn_id="t"), rec("turn_context", turn_id="t", model="gpt-x")
    trigger = rec("inter_agent_communication_metadata", trigger_turn=True)
    message = lambda to="/root/w", turn="t": rec("response_item", type="agent_message", recipient=to, internal_chat_message_metadata_passthrough={"turn_id": turn})
    assert models(spark, m, count(1), start, context, count(2), trigger, message("/root/other"), count(3), message(), count(4)) == ["gpt-x"]
    assert models(spark, m, start, trigger, context, message(), count(4)) == []
    assert models(spark, m, start, context, trigger, rec("event_msg", type="task_started", turn_id="u"), message(), count(4)) == []
    assert models(spark, m, start, context, trigger, message(turn="z"), count(3)) == []


class Sequential:
    """The rules read one record after the other."""

    def __init__(self, forked, subagent):
        self.turn, self.over, self.setting, self.models, self.out, self.snap = "", False, "unknown", {}, [], None
        self.state = "off" if not forked else "task" if subagent else "live"
        self.fork = None

    def feed(self, e):
        kind = e[0]
        if kind == "context":
            if self.state == "context":
                if e[1] == self.fork:
                    self.state, self.fork_model = "trigger", e[2]
            elif self.state == "off":
                self.over = self.over and e[1] == self.turn
                self.turn = e[1]
                if e[2]:
                    self.models[e[1]] = e[2]
        elif kind == "trigger" and self.state == "trigger":
            self.state = "message"
        elif kind == "message" and self.state == "message" and e[1] in (None, self.fork):
            self.turn, self.state = self.fork, "off"
            if self.fork_model:
                self.models[self.turn] = self.fork_model
        elif kind == "settings":
            self.setting = e[1]
            self.over = self.over or self.turn != ""
        elif kind == "start":
            if self.state == "live":
                if not e[2]:
                    return
                self.state = "off"
            elif self.state != "off":
                if e[1]:
                    self.state, self.fork = "context", e[1]
                return
            self.turn = e[1] or self.turn
            self.over = False
        elif kind == "complete" and e[1] in (None, self.turn):
            self.turn, self.over = "", False
        elif kind == "count" and self.state == "off" and e[1] != self.snap:
            self.snap = e[1]
            turn = e[2] or self.turn
            active = self.over and turn == self.turn and self.setting != "unknown"
            self.out.append((turn, self.setting if active else None, self.setting))

    def result(self):
        return [(t, a or self.models.get(t) or s) for t, a, s in self.out]


def test_windows_equal_the_sequential_rules(spark):
    rng, contents, want = random.Random(11), [], []
    for _ in range(150):
        forked, subagent = rng.random() < 0.5, rng.random() < 0.5
        machine = Sequential(forked, subagent)
        lines = [meta(**({"forked_from_id": "f"} if forked else {}), thread_source="subagent" if subagent else "user", agent_path="/root/w")]
        for _ in range(rng.randrange(4, 40)):
            turn, model = rng.choice(["a", "b", "c"]), rng.choice([None, "m1", "m2"])
            e = rng.choice([("context", turn, model), ("settings", rng.choice(["s1", "unknown"])), ("start", rng.choice([turn, None]), rng.random() < 0.4), ("complete", rng.choice([turn, None])), ("count", rng.randrange(6), rng.choice([None, turn])), ("count", rng.randrange(6), None), ("trigger",), ("message", rng.choice([None, turn]))])
            machine.feed(e)
            lines.append({
                "context": lambda: rec("turn_context", turn_id=e[1], model=e[2]), "settings": lambda: rec("event_msg", type="thread_settings_applied", thread_settings={"model": e[1]}),
                "start": lambda: rec("event_msg", type="task_started", turn_id=e[1], started_at=1784077323 + (9 if e[2] else -9)), "complete": lambda: rec("event_msg", type="task_complete", turn_id=e[1]), "count": lambda: count(e[1], turn_id=e[2]),
                "trigger": lambda: rec("inter_agent_communication_metadata", trigger_turn=True), "message": lambda: rec("response_item", type="agent_message", recipient="/root/w", internal_chat_message_metadata_passthrough={"turn_id": e[1]}),
            }[e[0]]())
        contents.append(lines)
        want.append(machine.result())
    got = [[] for _ in want]
    for r in attribution.parse(files(spark, *contents))["events"].orderBy("token_event_ordinal").collect():
        got[int(r.path.split("-")[-1].removesuffix(".jsonl"))].append((r.turn_id, r.model))
    assert got == want and sum(map(len, want)) > 300


def test_rules_for_texts(spark):
    one = lambda c: spark.range(1).select(c).head()[0]
    ms = lambda s: one(text.timestamp_epoch_ms(F.lit(s)))
    assert ms("1970-01-01T00:00:01.9999Z") == 1999 and ms("1970-01-01T08:00:00+08:00") == 0
    assert [ms(s) for s in ("1970-01-01T00:00:00", "1970-01-01 00:00:00Z", "1970-01-01T00:00Z", "1970-13-01T00:00:00Z", "1970-02-30T00:00:00Z", "1970-01-01T00:00:60Z", "0000-01-01T00:00:00Z")] == [None] * 7
    ids = lambda p: one(text.fallback_rollout_id(F.lit(p)))
    v7 = "0190ABCD-0000-7000-8000-00000000000F"
    assert ids(f"/x/rollout-2026-01-01T00-00-00-{v7}.jsonl") == v7.lower() and ids("/x/rollout-2026-legacy-7.jsonl") == "legacy-7"
    assert one(text.normalized_id(F.lit(f" {v7} "))) == v7.lower() and one(text.normalized_id(F.lit("x"))) is None
    assert one(text.uuid_v7_epoch_ms(F.lit(v7))) == int("0190abcd0000", 16)
    assert [one(text.project_name(F.lit(p).cast("string"))) for p in (None, " ", "/", "/a/b//", "c:\\x\\y", " solo ")] == ["Codex", "Codex", "Codex", "b", "y", "solo"]


@pytest.mark.parametrize("name", ["parse_rollout", "open_turns"])
def test_logs_are_read_once_and_dealt_out_by_file_once(spark, name):
    from ledgerloom.plans import catalogue, upkeep  # noqa: F401

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("REPARTITION_BY_NUM") == 1 and "Window" in plan
