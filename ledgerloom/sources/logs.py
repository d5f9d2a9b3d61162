"""Log files in one reading: a distributed listing, then byte ranges that give records and facts of the same bytes.

A listing goes down the folders level by level; the folders of a level are listed in parallel, by tasks where they are
many. A root that is not there
has no files; a folder that cannot be read is reported and holds up nothing else; links are never followed.

A scan splits each file, at the size that the listing saw, into ranges. A range owns the lines that begin in it and
reads on to the end of its last one, so a log of any size spreads over tasks. Each range checks the file before and after it
reads: a file that became shorter, or whose bytes before the listed size changed, is reported and left for the next
inventory. One that only grew is taken as it was when it was listed, and its facts say so: the next inventory sees a
larger file. Records and facts come from the same bytes, so nothing can fall between them.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import stat
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schema

from .records import BOUNDARY_BYTES, _arrow_schema, flat
from .staging import cut

PATTERN = "rollout-*.jsonl"
#: Bytes of a file that one task reads; tasks that a scan is dealt to at most.
RANGE_BYTES, MOST_TASKS = 64 << 20, 10_000
#: What a task reads on average: bytes, and ranges where these are small.
TASK_BYTES, TASK_RANGES = 4 * RANGE_BYTES, 512
#: Folders of a level that the driver lists itself; from a larger level on, tasks do.
FEW_FOLDERS = 256
#: Bytes read at a time.
CHUNK = 1 << 20

FILES = "file_path string, size_bytes long, modified_at_epoch_ms long"
_LISTED = "kind string, path string, size_bytes long, modified_ns long, message string"
#: What a range tells about its bytes; rows of records have nulls here.
_FACTS = T.StructType(
    [T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("lines", T.LongType()), ("stable", T.LongType()), ("boundary", T.StringType()), ("hash", T.StringType()), ("error", T.StringType()))]
)


# --- file systems -----------------------------------------------------------------------------------------------------


def is_local(uri: str) -> bool:
    return "://" not in uri and not uri.startswith("file:")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it."""
    return (pafs.LocalFileSystem(), uri) if is_local(uri) else pafs.FileSystem.from_uri(uri)


def facts_of_file(uri: str) -> tuple[int, int]:
    """Size and time of change in nanoseconds; FileNotFoundError if there is no such file."""
    if is_local(uri):
        s = os.stat(uri, follow_symlinks=False)
        return s.st_size, s.st_mtime_ns
    fs, path = open_fs(uri)
    info = fs.get_file_info(path)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(uri)
    return info.size, info.mtime_ns or 0


def is_log(name: str) -> bool:
    return name.startswith("rollout-") and fnmatch.fnmatch(name.lower(), PATTERN)


def entries(folder: str, root: bool) -> Iterator[dict]:
    """What is in a folder: log files, folders, and a failure if it cannot be read. Links are left out."""
    row = {"kind": None, "path": folder, "size_bytes": None, "modified_ns": None, "message": None}
    try:
        if is_local(folder):
            mode = os.lstat(folder).st_mode
            if stat.S_ISLNK(mode):
                raise OSError("a link is outside the collector's scope")
            with os.scandir(folder) as found:
                for x in sorted(found, key=lambda x: x.name):
                    if x.is_symlink():
                        continue
                    if x.is_dir(follow_symlinks=False):
                        yield row | {"kind": "folder", "path": x.path}
                    elif is_log(x.name):
                        s = x.stat(follow_symlinks=False)
                        yield row | {"kind": "file", "path": x.path, "size_bytes": s.st_size, "modified_ns": s.st_mtime_ns}
        else:
            fs, base = open_fs(folder)
            head = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
            for x in fs.get_file_info(pafs.FileSelector(base)):
                if x.type == pafs.FileType.Directory:
                    yield row | {"kind": "folder", "path": head + x.path}
                elif x.type == pafs.FileType.File and is_log(x.base_name):
                    yield row | {"kind": "file", "path": head + x.path, "size_bytes": x.size, "modified_ns": x.mtime_ns or 0}
    except FileNotFoundError as e:
        if not root and is_local(folder) and os.path.islink(folder):
            yield row | {"kind": "failure", "message": str(e)}
    except OSError as e:
        yield row | {"kind": "failure", "message": str(e)[:500]}


def listing(spark: SparkSession, *roots: str) -> tuple[DataFrame, DataFrame]:
    """(file_path, size_bytes, modified_at_epoch_ms) of all log files below the roots, and (path, message) of folders that
    could not be read. From a level with
    many folders on, these are listed by tasks, level by level."""
    arrow = pa.schema([("kind", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()), ("modified_ns", pa.int64()), ("message", pa.string())])

    def level(folders: DataFrame, first: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for folder in batch.column("path").to_pylist():
                    rows = list(entries(folder, first))
                    for at in range(0, len(rows), 10_000):
                        yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema=arrow)

        return cut(folders.mapInArrow(run, _LISTED), "listing")

    near, first = [r.rstrip("/") or "/" for r in dict.fromkeys(roots)], True
    few: list[dict] = []
    with ThreadPoolExecutor(16) as pool:
        while near and len(near) <= FEW_FOLDERS and len(few) <= 100 * FEW_FOLDERS:  # small trees need no job
            rows = [x for found in pool.map(lambda f: list(entries(f, first)), near) for x in found]  # noqa: B023
            few += [x for x in rows if x["kind"] != "folder"]
            near, first = [x["path"] for x in rows if x["kind"] == "folder"], False
    rows = spark.createDataFrame([tuple(x.values()) for x in few], _LISTED)
    while near is not None and (not isinstance(near, list) or near):
        folders = spark.createDataFrame([(f,) for f in near], "path string") if isinstance(near, list) else near
        found = level(folders, first)
        rows, deeper, first = rows.unionByName(found), found.where("kind = 'folder'").select("path").distinct(), False
        n = deeper.count()
        near = deeper.repartition(min(max(n // 16, 1), MOST_TASKS)) if n else None
    files = rows.where("kind = 'file'").select(F.col("path").alias("file_path"), "size_bytes", F.expr("modified_ns div 1000000").alias("modified_at_epoch_ms")).distinct()
    return files, rows.where("kind = 'failure'").select("path", "message")


# --- one range --------------------------------------------------------------------------------------------------------


class ChangedFile(Exception):
    """A file is not what the listing saw."""


def unchanged(path: str, size: int, modified_ms: int) -> bool:
    """Raises if the file is shorter, or was written again at the listed size. Returns whether it has grown."""
    now, ns = facts_of_file(path)
    if now < size or (now == size and ns // 1_000_000 != modified_ms):
        raise ChangedFile("the file changed while it was read")
    return now > size


def lines_of_range(path: str, size: int, start: int, end: int, digest: hashlib._Hash | None = None) -> Iterator[tuple[int, bytes, int]]:
    """(offset, line, offset after it) of the complete lines that begin in [start, end) of the first `size` bytes. A line
    ends with its line feed, which is left out, as is one carriage return before it. digest gets the range's bytes."""
    fs, own = open_fs(path)
    with fs.open_input_file(own) as f:
        at = position = max(start - 1, 0)  # where the next line begins; where the next chunk does
        f.seek(position)
        pieces: list[bytes] = []  # of a line that has not ended
        skipping = start > 0  # the line that holds the byte before the range is another range's
        while at < end and (chunk := f.read(min(CHUNK, size - position))):
            if digest is not None:
                digest.update(chunk[max(start - position, 0) : max(end - position, 0)])
            position += len(chunk)
            *lines, rest = chunk.split(b"\n")
            for line in lines:
                whole = b"".join([*pieces, line])
                pieces, begin, at = [], at, at + len(whole) + 1
                if skipping:
                    skipping = False
                elif begin < end:
                    yield begin, whole.removesuffix(b"\r"), at
            pieces.append(rest)


def boundary_hash(path: str, end: int) -> str:
    fs, own = open_fs(path)
    start = max(0, end - BOUNDARY_BYTES)
    with fs.open_input_file(own) as f:
        f.seek(start)
        return hashlib.sha256(f.read(end - start)).hexdigest()


def range_hash(path: str, size: int, start: int, end: int) -> str:
    digest = hashlib.sha256()
    for _ in lines_of_range(path, size, start, end, digest):
        pass
    return digest.hexdigest()


# --- scans ------------------------------------------------------------------------------------------------------------


def scan(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The files (FILES) read once: rows of schema.RECORDS whose line is the line's byte offset, and a row of facts for
    each range. Written to the shared folder, so that records and facts are of one reading."""
    spark = files.sparkSession
    count = F.greatest(F.ceil(F.col("size_bytes") / range_bytes), F.lit(1))
    ranges = files.select("file_path", "size_bytes", "modified_at_epoch_ms", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("part"))
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.least(F.col("size_bytes"), F.lit(range_bytes))), F.lit(0))).head()
    tasks = min(max(size // TASK_BYTES, n // TASK_RANGES, spark.sparkContext.defaultParallelism), MOST_TASKS)
    wide = T.StructType([*schema.RECORDS.fields, *_FACTS.fields])
    arrow = _arrow_schema()
    for f, t in zip(_FACTS.fieldNames(), (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True):
        arrow = arrow.append(pa.field(f, t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, modified, part in zip(*(batch.column(c).to_pylist() for c in ("file_path", "size_bytes", "modified_at_epoch_ms", "part")), strict=True):
                start, end = part * range_bytes, min((part + 1) * range_bytes, size)
                fact, rows = {"path": path, "part": part, "lines": 0}, []
                digest = hashlib.sha256()
                try:
                    unchanged(path, size, modified)
                    for at, raw, after in lines_of_range(path, size, start, end, digest):
                        rows.append(flat(path, at, raw) | {"part": part})
                        fact["lines"] += 1
                        fact["stable"] = after
                        if len(rows) >= 4_096:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
                    if fact["lines"]:
                        fact["boundary"] = boundary_hash(path, fact["stable"])
                    fact["hash"] = digest.hexdigest()
                    if unchanged(path, size, modified) and range_hash(path, size, start, end) != fact["hash"]:
                        raise ChangedFile("the file changed while it was read")
                except FileNotFoundError:
                    fact["error"] = "gone"
                except (OSError, ChangedFile) as e:
                    fact["error"] = str(e)[:500] or type(e).__name__
                yield pa.RecordBatch.from_pylist([*rows, fact], schema=arrow)

    return cut(ranges.repartition(tasks, "file_path", "part").mapInArrow(run, wide), "scan")


def facts(scanned: DataFrame, files: DataFrame) -> DataFrame:
    """path, size_bytes, modified_at_epoch_ms, stable_length, content_hash, boundary_hash, error of the scanned files."""
    ranges = scanned.where("class is null")
    whole = ranges.groupBy("path").agg(
        F.coalesce(F.max("stable"), F.lit(0)).alias("stable_length"), F.max_by("boundary", "stable").alias("_boundary"), F.max("error").alias("error"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.coalesce("hash", F.lit("")).alias("hash")))), lambda x: x["hash"]), ","), 256).alias("content_hash"),
    )
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    own = files.select(F.col("file_path").alias("path"), "size_bytes", "modified_at_epoch_ms")
    return own.join(whole, "path").select("path", "size_bytes", "modified_at_epoch_ms", "stable_length", "content_hash", F.coalesce("_boundary", empty).alias("boundary_hash"), "error")


def records_of(scanned: DataFrame) -> DataFrame:
    """The records of files without an error; their line is a byte offset."""
    failed = scanned.where("class is null and error is not null").select("path").distinct()
    return scanned.where("class is not null").join(failed, "path", "left_anti").select(*schema.RECORDS.fieldNames())


def numbered(scanned: DataFrame) -> DataFrame:
    """The records with line numbers from 0: places within a range and the sum of the lines of earlier ones."""
    ranges = scanned.where("class is null").select("path", "part", "lines")
    earlier = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("path", "part", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("path", "part").orderBy("line")) - 1
    rows = scanned.where("class is not null").withColumn("line", within.cast("long"))
    return rows.join(before, ["path", "part"]).withColumn("line", F.col("line") + F.col("_before")).select(*schema.RECORDS.fieldNames())
