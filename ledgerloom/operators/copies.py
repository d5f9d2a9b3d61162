"""Deciding on all copies of a session in one pass.

The files of a session are taken in the order of their paths; each is compared with what the ledger holds at that point,
which an earlier one may have replaced. Sequences of events are compared by prints: a running hash at the lengths that
occur in the session, so a session with many copies takes as many jobs as one with two, and no events are gathered.
The fold is keyed by session; its state is the holder of the ledger's events and the status of each source.

Kinds of rows of a session: `stored` (the ledger's row and prints), `source` (a known file), `copy` (a file that was
read), `seed` (an unchanged file that was read for a recovery), `broken` (its canonical file has damaged records), `moved`
(its canonical file now holds another session).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .canonical import ATTRIBUTES, DIVERGED, EQUAL, EXTENSION, SHORTER, identity

_PRINT = "array<struct<n:bigint,i:string,s:string>>"
_ATTRS = ", ".join(f"{a}: {'boolean' if a == 'is_realtime_voice' else 'string'}" for a in ATTRIBUTES)
#: One row for each kind; see the module.
FOLD = (
    f"rollout_id string, kind string, path string, n long, prints {_PRINT}, attrs struct<{_ATTRS}>, title string, activity long, stable_length long, size_bytes long, "
    "modified_at_epoch_ms long, boundary_hash string, sure boolean, expected boolean, legacy boolean, target_free boolean, status string, present boolean"
)
#: What the fold decides: a row for each file it touches. needs: why the file must be read (again) before the session can be
#: decided (confirm, fresh, seed); taken: its events are the ledger's; free: the file may join its new session.
DECIDED = "rollout_id string, path string, decision string, status string, message string, reason string, taken boolean, free boolean, needs string, usage_changed boolean"
_ARROW = pa.schema([("rollout_id", pa.string()), ("path", pa.string()), ("decision", pa.string()), ("status", pa.string()), ("message", pa.string()), ("reason", pa.string()), ("taken", pa.bool_()), ("free", pa.bool_()), ("needs", pa.string()), ("usage_changed", pa.bool_())])
MESSAGES = {
    "source-diverged": "the file diverges from the events of its session", "source-attribution-diverged": "attributes or models of the file differ from its session's",
    "canonical-source-malformed": "the canonical file has damaged records", "canonical-source-rollout-changed": "the canonical file now holds another session",
}


def prints(events: DataFrame, key: str, lengths: DataFrame) -> DataFrame:
    """key, prints: running hashes of the events' identities (i) and identities with models (s) of each key (path or
    rollout_id) at the lengths (key, n) that are asked for. Places are part of what is hashed."""
    order = Window.partitionBy(key).orderBy("token_event_ordinal")
    places = events.select(key, "token_event_ordinal", F.row_number().over(order).alias("n"), identity().alias("i"), identity(True).alias("s"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    running = lambda c: F.concat_ws(":", *[F.hex(F.bit_xor(F.xxhash64(F.lit(k), F.col("n"), F.col(c))).over(so_far)) for k in (1, 2)])
    hashed = places.select(key, F.col("n").cast("long").alias("n"), running("i").alias("i"), running("s").alias("s"))
    return hashed.join(lengths.select(key, "n").distinct(), [key, "n"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "i", "s"))).alias("prints"))


def relation(existing: dict, candidate: dict, by: str) -> str:
    """How a candidate's events relate to the existing ones: rows with n and prints at the length of either. by: i or s."""
    n = min(existing["n"], candidate["n"])
    if n and existing["prints"].get(n, {}).get(by) != candidate["prints"].get(n, {}).get(by):
        return DIVERGED
    return EQUAL if existing["n"] == candidate["n"] else EXTENSION if candidate["n"] > existing["n"] else SHORTER


class Session:
    """The state of a fold over one session's files."""

    def __init__(self, rows: list[dict]):
        for r in rows:
            r["prints"] = {p["n"]: p for p in r["prints"] or []}
        self.id = rows[0]["rollout_id"]
        self.sources = {r["path"]: {"status": r["status"], "present": bool(r["present"])} for r in rows if r["kind"] == "source"}
        self.stored = next((r for r in rows if r["kind"] == "stored"), None)
        self.holder = self.stored or {"n": 0, "prints": {}, "attrs": None, "path": None}
        self.canonical = self.holder["path"]
        self.read = sorted((r for r in rows if r["kind"] in ("copy", "broken", "moved")), key=lambda r: r["path"])
        self.copies = {r["path"]: r for r in rows if r["kind"] in ("copy", "seed")}
        self.out: dict[str, dict] = {}
        self.needs: dict[str, str] = {}
        self.taken: dict | None = None
        self.usage_changed = False

    # what is put down

    def put(self, path: str, decision: str, status: str | None, reason: str | None = None, **more: object) -> None:
        if status is not None:
            there = decision not in ("replaced", "resolved") or self.sources.get(path, {}).get("present", True)
            self.sources[path] = {"status": status, "present": there}
        self.out[path] = self.out.get(path, {}) | {"decision": decision, "status": status, "reason": reason, "message": MESSAGES.get(reason)} | more

    def take(self, row: dict, decision: str) -> None:
        """The file's events become the ledger's and it the canonical one; its predecessor is a candidate."""
        before, old = self.holder, self.canonical
        same = before["attrs"] == row["attrs"]
        picker = (before.get("title"), before.get("activity")) == (row["title"], row["activity"])
        self.usage_changed |= relation(before, row, "s") != EQUAL or (not same and bool(before["n"] or row["n"])) or (not picker and not row["attrs"]["is_realtime_voice"])
        if old and old != row["path"] and self.sources.get(old, {}).get("status") == "canonical":
            self.put(old, "replaced", "candidate")
        self.put(row["path"], decision, "canonical")
        self.holder, self.canonical, self.taken = row, row["path"], row

    # the rules

    def recover(self, conflict: str) -> bool:
        """Another copy takes the place of a canonical file that can no longer be followed: one with the session's
        attributes and events, equal or continued; continued ones first, then by stable length, time and path."""
        if self.holder["attrs"] is None:
            return False
        unread = [p for p, s in self.sources.items() if s["present"] and p != conflict and p not in self.copies and p not in {r["path"] for r in self.read}]
        if unread:
            self.needs |= dict.fromkeys(unread, "seed")
            return False
        found = []
        for path, row in self.copies.items():
            r = relation(self.holder, row, "s")
            if path != conflict and row["attrs"] == self.holder["attrs"] and r in (EQUAL, EXTENSION):
                found.append((r != EXTENSION, -row["stable_length"], -row["modified_at_epoch_ms"], path, row))
        unsure = [x[3] for x in found if not x[4]["sure"]]
        if unsure:
            self.needs |= dict.fromkeys(unsure, "fresh")
            return False
        if not found:
            return False
        row = min(found, key=lambda x: x[:4])[4]
        self.take(row, "recover")
        self.put(conflict, "resolved", "candidate")
        return True

    def confirm(self, row: dict) -> bool:
        if not row["sure"]:
            self.needs[row["path"]] = "confirm"
        return bool(row["sure"])

    def broken(self, row: dict) -> None:
        if self.confirm(row):
            self.put(row["path"], "broken", "conflict", "canonical-source-malformed")
            self.recover(row["path"])

    def moved(self, row: dict, rebuild: bool) -> None:
        if not self.confirm(row):
            return
        alone = sum(s["status"] in ("canonical", "conflict") and s["present"] for s in self.sources.values()) == 1
        if rebuild and row["legacy"]:
            if row["target_free"] and alone:
                self.put(row["path"], "rekey", "canonical")
                return
        self.put(row["path"], "moved", "conflict", "canonical-source-rollout-changed")
        if self.recover(row["path"]):
            self.out[row["path"]]["free"] = True

    def copy(self, row: dict) -> None:
        if self.taken is row:  # in a recovery
            return
        own = self.sources.get(row["path"])
        mine = self.canonical == row["path"]
        if not mine and self.canonical and self.sources.get(self.canonical, {}).get("status") == "conflict":
            self.recover(self.canonical)
            if self.needs or self.canonical == row["path"]:
                return
        i, s = relation(self.holder, row, "i"), relation(self.holder, row, "s")
        same = self.holder["attrs"] == row["attrs"]
        rewritten = mine and own is not None and row.get("rewritten")
        if mine and (rewritten or i in (SHORTER, DIVERGED) or s in (SHORTER, DIVERGED) or not same):
            if self.confirm(row):
                self.take(row, "confirm_and_replace")
        elif i == DIVERGED:
            self.put(row["path"], "conflict", "conflict", "source-diverged")
        elif i == SHORTER:
            self.put(row["path"], "candidate", "candidate")
        elif self.holder["n"] and not mine and not (same and s in (EQUAL, EXTENSION)):
            self.put(row["path"], "conflict", "conflict", "source-attribution-diverged")
        elif i == EXTENSION or not self.canonical or mine or not self.sources.get(self.canonical, {}).get("present"):
            self.take(row, "promote")
        else:
            self.put(row["path"], "candidate", "candidate")

    def rebuild(self) -> None:
        """One copy decides: the canonical one, else the longest, largest, latest, first; a file that was another
        session's is rejected."""
        rows = [r for r in self.read if r["kind"] == "copy"]
        for r in rows:
            if not r["expected"]:
                self.out[r["path"]] = {"decision": "reject", "status": None, "reason": "source-rollout-changed", "message": "the known file now holds another session"}
        self.read = [r for r in self.read if r["kind"] != "copy" or r["expected"]]
        viable = [r for r in rows if r["expected"] and (self.sources.get(r["path"], {}).get("status") != "conflict" or r["path"] == self.canonical)]
        if not viable:
            return
        row = min(viable, key=lambda r: (r["path"] != self.canonical, -r["stable_length"], -r["size_bytes"], -r["modified_at_epoch_ms"], r["path"]))
        self.take(row, "replace")
        self.read = [r for r in self.read if r is not row]

    def decide(self, rebuild: bool) -> list[dict]:
        for row in [r for r in self.read if r["kind"] == "moved"] if rebuild else []:
            self.moved(row, rebuild)
        if rebuild and not any(o["decision"] == "rekey" for o in self.out.values()):
            self.rebuild()
        for row in self.read:
            if self.needs:  # what comes later depends on it
                break
            if row["kind"] == "broken":
                self.broken(row)
            elif row["kind"] == "moved":
                if not rebuild:
                    self.moved(row, rebuild)
            else:
                self.copy(row)
        if self.needs:
            return [{"rollout_id": self.id, "path": p, "needs": why} for p, why in self.needs.items()]
        rows = [{"rollout_id": self.id, "path": p, "taken": self.taken is not None and self.taken["path"] == p, "free": bool(o.get("free")), "usage_changed": False} | {k: o.get(k) for k in ("decision", "status", "message", "reason")} for p, o in self.out.items()]
        for r in rows:
            r["usage_changed"] = bool(r["taken"] and self.usage_changed)
        return rows


def fold(rows: DataFrame, rebuild: bool = False) -> DataFrame:
    """DECIDED of the sessions in rows (FOLD, and `rewritten`). A session's rows, one for each of its files, meet in one
    task; sessions spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and row["rollout_id"] != group[0]["rollout_id"]:
                    out += Session(group).decide(rebuild)
                    group = []
                group.append(row)
            if len(out) > 1_000:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                out = []
        if group:
            out += Session(group).decide(rebuild)
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return rows.repartition("rollout_id").sortWithinPartitions("rollout_id").mapInArrow(run, DECIDED)
