"""Attribution that goes on where a file was left: events of appended records from a stored state.

The state of a canonical file, kept in its checkpoint, is what the rules of attribution.py know at its end: the current
turn and setting, the last counts, the next ordinal, and for each turn the model last stated for it and whether events
depend on that. A file with a closed gate, or without its first session_meta, has no state to go on from. Where appended
records change what is already in the ledger (a model that is stated late, a damaged or skipped record), the file asks to
be read as a whole instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions.text import timestamp_epoch_ms
from ledgerloom.sources.staging import cut

#: An event of a file, or (without an ordinal) its new state or why it must be read as a whole.
RESUMED = "path string, whole string, state string, activity long, timestamp string, timestamp_epoch_ms long, token_event_ordinal long, turn_id string, model string, input_tokens long, cached_input_tokens long, output_tokens long, reasoning_output_tokens long, event_signature string"
_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (f.split() for f in RESUMED.split(", "))])


def states(lines: DataFrame, counts: DataFrame, events: DataFrame, meta: DataFrame) -> DataFrame:
    """path, state of whole files: lines with turns, counts (candidates) and events as attribution.py has them. Files whose
    gate is closed or that have no session_meta have none."""
    at_end = lines.groupBy("path").agg(F.max_by(F.struct("current_turn", "overridden", "current_model", "open"), "line").alias("e"), F.max_by("last_set", F.when(F.col("last_set").isNotNull(), F.col("line"))).alias("last_set"))
    kept = counts.where("cumulative_snapshot is not null").groupBy("path").agg(F.max_by("cumulative_snapshot", "line").alias("snapshot"))
    ordinals = events.groupBy("path").agg((F.max("token_event_ordinal") + 1).alias("ordinal"))
    used = events.where("turn_id <> ''").groupBy("path", "turn_id").agg(F.max(~F.col("active")).alias("used"))
    stated = lines.where("stated_turn is not null").groupBy("path", F.col("stated_turn").alias("turn_id")).agg(F.max_by("stated_model", "line").alias("model"))
    turns = stated.join(used, ["path", "turn_id"], "full_outer").groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("turn_id").alias("turn"), "model", F.coalesce("used", F.lit(False)).alias("used")))).alias("turns"))
    x = meta.where("meta_line is not null").select("path", "is_realtime_voice").join(at_end, "path").where("e.open").join(kept, "path", "left").join(ordinals, "path", "left").join(turns, "path", "left")
    none = F.array().cast("array<struct<turn:string,model:string,used:boolean>>")
    state = F.struct(
        F.col("e.current_turn").alias("turn"), F.col("last_set").alias("last_set"), F.col("e.overridden").alias("overridden"), F.col("e.current_model").alias("model"), F.col("snapshot").alias("snapshot"),
        F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.col("is_realtime_voice").alias("voice"), F.coalesce("turns", none).alias("turns"),
    )
    return x.select("path", F.to_json(state).alias("state"))


class Whole(Exception):
    """The file must be read as a whole."""


class Reader:
    """The rules of attribution.py, one record after the other, from a state on."""

    def __init__(self, state: str):
        s = json.loads(state)
        self.turn, self.last_set, self.overridden, self.model = s["turn"], s.get("last_set"), s["overridden"], s["model"]
        self.snapshot, self.ordinal, self.voice = s.get("snapshot"), s["ordinal"], s["voice"]
        self.turns = {t["turn"]: [t.get("model"), t["used"]] for t in s["turns"]}
        self.activity = 0

    def state(self) -> str:
        turns = [{"turn": t, "model": m, "used": u} for t, (m, u) in sorted(self.turns.items())]
        return json.dumps({"turn": self.turn, "last_set": self.last_set, "overridden": self.overridden, "model": self.model, "snapshot": self.snapshot, "ordinal": self.ordinal, "voice": self.voice, "turns": turns}, ensure_ascii=False)

    def read(self, r: dict) -> dict | None:
        """The event of a record (schema.RECORDS and ts_ms), if it gives one."""
        if r["class"] in ("oversized_opaque", "null_padding") or r["class"] not in (schema.OBJECT, *schema.HARMLESS):
            raise Whole(r["class"])
        if r["class"] != schema.OBJECT:
            return None
        self.activity = max(self.activity, r["ts_ms"] or 0)
        if not r["has_payload"]:
            return None
        kind = r["payload_type"] if r["type"] == "event_msg" else r["type"]
        context, task = kind == "turn_context" and r["turn_id"] is not None, kind == "task_started"
        before = self.turn
        if context or (task and r["turn_id"] is not None):
            self.last_set = self.turn = r["turn_id"]
        done = kind == "task_complete" and (r["turn_id"] is None or r["turn_id"] == self.last_set)
        if done:
            self.turn = ""
        setting = r["settings_model"] if kind == "thread_settings_applied" else None
        if setting is not None and self.turn:
            self.overridden = True
        elif done or task or (context and r["turn_id"] != before):
            self.overridden = False
        if setting is not None:
            self.model = setting
        if context and r["model"] is not None:
            model, used = self.turns.get(r["turn_id"], (None, False))
            if used and model != r["model"]:
                raise Whole("late model")
            self.turns[r["turn_id"]] = [r["model"], used]
        return self.count(r) if kind == "token_count" and not self.voice else None

    def count(self, r: dict) -> dict | None:
        u, t = r["usage"], r["total"]
        if u is None or t is None or not (u["input"] or u["cached"] or u["output"] or u["reasoning"]) or u["cached"] > u["input"] or u["reasoning"] > u["output"] or r["ts_ms"] is None:
            return None
        snapshot = ":".join(str(t[c]) for c in ("input", "cached", "output", "reasoning", "total"))
        if snapshot == self.snapshot:
            return None
        self.snapshot = snapshot
        turn, known = r["turn_id"] if r["turn_id"] is not None else self.turn, self.model != "unknown"
        stated, used = self.turns.get(turn, (None, False))
        active = self.overridden and turn == self.turn and known
        if turn:
            self.turns[turn] = [stated, used or not active]
        tokens = [u[c] for c in ("input", "cached", "output", "reasoning")]
        self.ordinal += 1
        return {
            "timestamp": r["ts"], "timestamp_epoch_ms": r["ts_ms"], "token_event_ordinal": self.ordinal - 1, "turn_id": turn, "model": self.model if active else stated or (self.model if known else "unknown"),
            **dict(zip(("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"), tokens, strict=True)), "event_signature": json.dumps([r["ts"], turn, *map(str, tokens), snapshot], ensure_ascii=False, separators=(",", ":")),
        }


#: What the rules read of a record.
_READ = ("path", "line", "class", "type", "ts", "has_payload", "payload_type", "turn_id", "model", "settings_model", "usage", "total")


def resumed(rows: DataFrame, held: DataFrame) -> DataFrame:
    """RESUMED: events of appended records (schema.RECORDS) of files with a state (path, state), and a row for each file with its
    new state, or why it must be read as a whole. A state goes ahead of its file's records, once, not with each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, path, why, read, out = None, None, None, False, []

        def close() -> None:
            if read:
                out.append({"path": path, "whole": why} if why else {"path": path, "state": reader.state(), "activity": reader.activity})

        for batch in batches:
            for r in batch.to_pylist():
                if r["state"] is not None:
                    close()
                    reader, path, why, read = Reader(r["state"]), r["path"], None, False
                    continue
                if r["path"] != path:
                    continue  # a file without a state
                read = True
                if why:
                    continue
                try:
                    event = reader.read(r)
                except Whole as e:
                    why = str(e)
                    continue
                if event is not None:
                    out.append({"path": path} | event)
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
            out = []
        close()
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    timed = rows.select(*_READ).withColumn("ts_ms", timestamp_epoch_ms(F.col("ts")))
    first = cut(held.where("state is not null").select("path", F.lit(-1).cast("long").alias("line"), "state"), "states")
    return timed.unionByName(first, allowMissingColumns=True).repartition("path").sortWithinPartitions("path", "line").mapInArrow(run, RESUMED)
