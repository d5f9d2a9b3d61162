"""A streaming source of append-only log files that delivers what was appended.

Spark's own file source reads a file once; session logs grow. This source's offset maps each file to the end of its
last complete line and to a hash of what stands before it. A batch reads the bytes between two offsets, one partition
for each file, on the executors. A file that is new, shrank, or whose earlier bytes changed, is read from its start with
`reset` set. What follows the last line feed waits for its end. The offset has the files that are there: one that went
gives a row with offset -2, and is a new one when it comes back. Links are not followed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ledgerloom.sources.logs import entries, open_fs

BOUNDARY_BYTES = 64 << 10
#: Files of a listing that are looked into at a time.
THREADS = 16
#: What a file's first row of a batch (offset -1) has in `raw`, as JSON: the file as it is after the batch.
FACTS = "size_bytes long, modified_at_epoch_ms long, stable_length long, boundary_hash string"


def _read(fs: pafs.FileSystem, path: str, start: int, end: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(max(end - start, 0))


def _stable(fs: pafs.FileSystem, path: str, size: int) -> int:
    """End of the last complete line."""
    end = size
    while end > 0:
        start = max(0, end - BOUNDARY_BYTES)
        at = _read(fs, path, start, end).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def _boundary(fs: pafs.FileSystem, path: str, end: int) -> str:
    return hashlib.sha256(_read(fs, path, max(0, end - BOUNDARY_BYTES), end)).hexdigest()


def _tail_of(path: str, size: int, modified: int) -> list | None:
    """Stable end, hash of what precedes it, size and time; nothing if the file went meanwhile."""
    fs, own = open_fs(path)
    try:
        end = _stable(fs, own, size)
        return [end, _boundary(fs, own, end), size, modified]
    except OSError:
        return None


class Tail(InputPartition):
    """facts: None for a file that is gone."""

    def __init__(self, path: str, start: int, end: int, reset: bool, facts: dict | None):
        self.path, self.start, self.end, self.reset, self.facts = path, start, end, reset, facts


class GrowingFilesReader(DataSourceStreamReader):
    def __init__(self, roots: list[str], most_files: int):
        self.roots, self.most_files = roots, most_files
        self.known: dict[str, list] = {}
        self.waiting: dict[str, int] = {}  # changed files and the listing that first saw the change
        self.listings = 0

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """Files already seen and up to `most_files` that are new or have changed: those that have waited longest first,
        then in the order of their paths, so files that change all the time hold up no other.

        A reader's first offset has all files: it cannot see the start offset, which an end offset must not fall behind,
        and a run with the availableNow trigger asks only once.
        """
        there, changed = set(), {}
        folders = [(root.rstrip("/") or "/", True) for root in self.roots]
        while folders:
            folder, top = folders.pop()
            for x in entries(folder, top):
                if x["kind"] == "folder":
                    folders.append((x["path"], False))
                elif x["kind"] == "file":
                    there.add(x["path"])
                    before = self.known.get(x["path"])
                    if not before or before[2:] != [x["size_bytes"], x["modified_ns"]]:
                        self.waiting.setdefault(x["path"], self.listings)
                        changed[x["path"]] = (x["size_bytes"], x["modified_ns"])
        self.known = {path: value for path, value in self.known.items() if path in there}
        self.waiting = {path: since for path, since in self.waiting.items() if path in changed}
        most = self.most_files if self.listings else len(changed)
        self.listings += 1
        picked = sorted(changed, key=lambda p: (self.waiting[p], p))[:most]
        with ThreadPoolExecutor(THREADS) as pool:
            for path, known in zip(picked, pool.map(lambda p: _tail_of(p, *changed[p]), picked), strict=True):
                if known is not None:
                    self.known[path] = known
                    del self.waiting[path]
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        for path, value in before.items():  # after a restart
            self.known.setdefault(path, value)
        out = []
        for path, (stable, boundary, size, modified) in now.items():
            old = before.get(path)
            if old and old[:2] == [stable, boundary]:
                continue
            fs, own = open_fs(path)
            reset = not old or stable < old[0] or _boundary(fs, own, old[0]) != old[1]
            facts = {"size_bytes": size, "modified_at_epoch_ms": modified // 1_000_000, "stable_length": stable, "boundary_hash": boundary}
            out.append(Tail(path, 0 if reset else old[0], stable, reset, facts))
        return out + [Tail(path, 0, 0, True, None) for path in before.keys() - now.keys()]

    def read(self, partition: Tail) -> Iterator[tuple]:
        if partition.facts is None:
            yield (partition.path, -2, None, True)
            return
        fs, path = open_fs(partition.path)
        at = partition.start
        yield (partition.path, -1, json.dumps(partition.facts).encode(), partition.reset)
        for raw in _read(fs, path, partition.start, partition.end).split(b"\n")[:-1]:
            yield (partition.path, at, raw.removesuffix(b"\r"), partition.reset)
            at += len(raw) + 1


class GrowingFiles(DataSource):
    """Options: roots (a JSON list of folders), maxFilesPerTrigger (16; from the second listing on). Rows: path, offset,
    raw, reset; a file's first row has offset -1 and its FACTS."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "path string, offset long, raw binary, reset boolean"

    def streamReader(self, schema) -> GrowingFilesReader:  # noqa: ANN001
        return GrowingFilesReader(json.loads(self.options["roots"]), int(self.options.get("maxfilespertrigger", self.options.get("maxFilesPerTrigger", "16"))))
