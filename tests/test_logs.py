"""The one-pass log source: listings, byte ranges, files that change meanwhile."""

from __future__ import annotations

import hashlib
import os

import pytest

from ledgerloom.sources import logs as source

from .test_collector import append, write
from .test_parser import count, meta


@pytest.fixture
def logs(tmp_path):
    return tmp_path / "logs"


def listed(spark, *roots):
    files, failures = source.listing(spark, *map(str, roots))
    return sorted(r.file_path for r in files.collect()), {r.path: r.message for r in failures.collect()}


def test_listing_skips_links_and_missing_roots(spark, logs, tmp_path):
    write(logs / "2026" / "01" / "rollout-a-1.jsonl", "{}")
    write(logs / "rollout-a-2.JSONL", "{}")
    write(logs / "Rollout-a-3.jsonl", "{}")
    write(tmp_path / "elsewhere" / "rollout-a-4.jsonl", "{}")
    os.symlink(tmp_path / "elsewhere", logs / "linked")
    os.symlink(tmp_path / "elsewhere" / "rollout-a-4.jsonl", logs / "rollout-a-5.jsonl")
    os.symlink(logs, logs / "2026" / "cycle")
    files, failures = listed(spark, logs, tmp_path / "missing", logs / "2026")
    assert [os.path.relpath(p, logs) for p in files] == ["2026/01/rollout-a-1.jsonl", "rollout-a-2.JSONL"] and failures == {}
    _, failures = listed(spark, logs, logs / "linked")
    assert list(failures) == [str(logs / "linked")]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_split_at_line_feeds(tmp_path, size):
    path = tmp_path / "rollout-x-1.jsonl"
    whole = b"\n\nfirst\r\n" + b"x" * 50 + b"\n\r\nlast whole\nopen tail"
    path.write_bytes(whole)
    want, at = [], 0
    for line in whole.split(b"\n")[:-1]:
        want.append((at, line.removesuffix(b"\r"), at + len(line) + 1))
        at += len(line) + 1
    got, hashes = [], []
    for start in range(0, len(whole), size):
        digest = hashlib.sha256()
        got += source.lines_of_range(str(path), len(whole), start, min(start + size, len(whole)), digest)
        hashes.append((digest.hexdigest(), hashlib.sha256(whole[start : start + size]).hexdigest()))
    assert got == want and all(a == b for a, b in hashes)


def test_long_lines_and_chunks(tmp_path, monkeypatch):
    monkeypatch.setattr(source, "CHUNK", 5)
    path = tmp_path / "rollout-x-1.jsonl"
    path.write_bytes(b"a" * 23 + b"\nbb\n" + b"c" * 11 + b"\n")
    assert [x[1] for s in (0, 10, 20, 30) for x in source.lines_of_range(str(path), 39, s, min(s + 10, 39))] == [b"a" * 23, b"bb", b"c" * 11]


def test_scan_gives_records_and_facts_of_one_reading(spark, logs):
    path = logs / "rollout-x-1.jsonl"
    write(path, meta(id="r1"), "not-json", *[count(k) for k in range(1, 30)], tail='{"part')
    write(logs / "rollout-x-2.jsonl")
    files, _ = source.listing(spark, str(logs))
    whole = path.read_bytes()
    stable = whole.removesuffix(b'{"part')
    by_size = {}
    for size in (1 << 20, 300):
        scanned = source.scan(files, size)
        fact = {r.path: r for r in source.facts(scanned, files).collect()}
        assert fact[str(path)].stable_length == len(stable) and fact[str(path)].boundary_hash == hashlib.sha256(stable).hexdigest() and fact[str(path)].error is None
        assert fact[str(logs / "rollout-x-2.jsonl")].stable_length == 0
        by_size[size] = [r["class"] for r in source.numbered(scanned).orderBy("path", "line").collect()], sorted(r.line for r in source.numbered(scanned).collect())
        assert scanned.where("class is null").count() == (2 if size > 300 else -(-len(whole) // 300) + 1)
    assert by_size[300] == by_size[1 << 20] and by_size[300][0][:2] == ["object", "malformed"] and by_size[300][1] == list(range(31))


def test_files_that_change_are_reported(spark, logs):
    grown, shorter, again, gone = (logs / f"rollout-x-{i}.jsonl" for i in range(4))
    for p in (grown, shorter, again, gone):
        write(p, meta(id="r"), count(1))
    files = spark.createDataFrame(source.listing(spark, str(logs))[0].collect(), source.FILES)
    append(grown, count(2))
    write(shorter, meta(id="r"))
    os.utime(again, (1, 1))
    gone.unlink()
    scanned = source.scan(files)
    fact = {os.path.basename(r.path)[10]: r for r in source.facts(scanned, files).collect()}
    assert fact["0"].error is None and fact["1"].error and fact["2"].error and fact["3"].error == "gone"
    assert {r.path for r in source.records_of(scanned).collect()} == {str(grown)} and source.records_of(scanned).count() == 2


def test_many_small_files_share_tasks(spark, tmp_path):
    rows = []
    for i in range(40):
        path = tmp_path / f"rollout-x-{i}.jsonl"
        path.write_bytes(b"{}\n")
        rows.append((str(path), 3, path.stat().st_mtime_ns // 1_000_000))
    scanned = source.scan(spark.createDataFrame(rows, source.FILES))
    assert scanned.where("class is not null").count() == 40 and len(scanned.inputFiles()) <= spark.sparkContext.defaultParallelism
