"""The ledger: Parquet tables in immutable snapshots, published by one atomic rename.

A snapshot is a small JSON file that names the folders of each table; what did not change is shared between snapshots.
Tables by session are kept in buckets, a folder each, by a hash of the rollout id: a commit that touches some sessions
writes their buckets alone. Reports are appended, a folder a commit, and merged when there are many; runs and
state, a row each, are one file. Readers hold on
to the snapshot they opened. One writer at a time; a failed write leaves the last snapshot in place.

A folder's name has the version it was written with; what older versions lack gets its defaults when it is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schema

from .paths import assert_writable

#: Tables sorted within their files so that row-group statistics prune.
SORTED = {"usage_events": ["timestamp_epoch_ms", "rollout_id", "token_event_ordinal"], "rollouts": ["conversation_id", "rollout_id"]}
#: Tables in buckets by rollout_id, and tables that grow by folders.
BUCKETED, APPENDED = ("rollouts", "usage_events", "source_files", "rollout_checkpoints"), ("collector_diagnostics",)
#: Buckets of a new ledger; folders of an appended table before they are merged.
BUCKETS, MOST_FOLDERS = 64, 32
#: Tasks that write one bucket of a large table.
SPREAD = 16


class Ledger:
    """Open or create the ledger below `root`, a folder that driver and executors share. protected: folders of logs, which
    root must not touch. buckets counts for a new ledger."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, protected: Iterable[str] = ()):
        self.protected = tuple(protected)
        assert_writable(root, *self.protected, spark=spark)
        self.spark, self.root = spark, root.rstrip("/")
        self._snapshots: dict[int, dict] = {}
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = lambda p: path(f"{self.root}/{p}")
        self._fs = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.revision, self.buckets = self._newest(), buckets
        if self.revision:
            found = self._snapshot(self.revision)
            self.buckets = found.get("buckets", buckets)
            if found["version"] > schema.VERSION:
                raise ValueError(f"the ledger has version {found['version']}, this library knows {schema.VERSION}")

    def _newest(self) -> int:
        if not self._fs.exists(self._path("snapshots")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("snapshots"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def _snapshot(self, revision: int) -> dict:
        """Snapshots never change: each is read once."""
        if revision not in self._snapshots:
            rows = self.spark.read.text(f"{self.root}/snapshots/{revision:012d}.json", wholetext=True).head()
            self._snapshots[revision] = json.loads(rows[0])
        return self._snapshots[revision]

    def bucket(self, rollout_id: Column) -> Column:
        return F.pmod(F.xxhash64(rollout_id), F.lit(self.buckets)).cast("int")

    def folders(self, table: str, revision: int | None = None) -> dict[str, list[str]]:
        """The table's folders in a snapshot by bucket; those of other tables, and of ledgers that had no buckets, by ``."""
        revision = self.revision if revision is None else revision
        found = self._snapshot(revision)["tables"].get(table) if revision else None
        return {} if found is None else {"": [found]} if isinstance(found, str) else found

    def read(self, table: str, revision: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table of a snapshot, or some of its buckets."""
        wanted = schema.struct(schema.TABLES[table])
        found = self.folders(table, revision)
        picked = [f for b, folders in found.items() if buckets is None or not b or int(b) in set(buckets) for f in folders]
        by_version: dict[int, list[str]] = {}
        for folder in picked:
            by_version.setdefault(schema.version_of(folder), []).append(f"{self.root}/{folder}")
        parts = [schema.upgraded(self.spark, table, version, folders) for version, folders in sorted(by_version.items())]
        if not parts:
            return self.spark.createDataFrame([], wanted)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        if buckets is not None and "" in found:
            out = out.where(self.bucket(F.col("rollout_id")).isin(list(buckets)))
        return out

    def tables(self, buckets: Iterable[int] | None = None) -> dict[str, DataFrame]:
        """All tables; of those by session only the given buckets."""
        return {t: self.read(t, buckets=buckets if t in BUCKETED else None) for t in schema.TABLES}

    def _write(self, name: str, df: DataFrame, by_bucket: bool) -> dict[str, list[str]]:
        columns = schema.struct(schema.TABLES[name])
        folder = f"tables/{name}-v{schema.VERSION}-{uuid.uuid4().hex}"
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns])
        order = SORTED.get(name, [])
        if not by_bucket:
            df.coalesce(1).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            return {"": [folder]}
        df = df.withColumn("bucket", self.bucket(F.col("rollout_id")))
        spread = F.pmod(F.hash(*(order or ["rollout_id"])), F.lit(SPREAD))  # a bucket, or a session, may be large
        df.repartition("bucket", spread).sortWithinPartitions("bucket", *order).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        there = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()]
        return {n.removeprefix("bucket="): [f"{folder}/{n}"] for n in there if n.startswith("bucket=")}

    def commit(self, touched: Iterable[int] | None = None, appended: dict[str, DataFrame] | None = None, **changed: DataFrame) -> int:
        """Writes the changed tables and publishes them together with the others as the next snapshot. touched: the tables
        by session hold these buckets alone and replace them. appended: rows added to a table."""
        before = {t: self.folders(t) for t in schema.TABLES}
        with ThreadPoolExecutor(len(schema.TABLES)) as pool:
            found = dict(zip(changed, pool.map(lambda x: self._write(x[0], x[1], x[0] in BUCKETED), changed.items()), strict=True))
        for name, written in found.items():
            if touched is not None and name in BUCKETED:
                if "" in before[name]:  # a ledger that had no buckets gets them now
                    written = self._write(name, self.read(name).where(~self.bucket(F.col("rollout_id")).isin(list(touched))), True) | written
                else:
                    written = {b: f for b, f in before[name].items() if int(b) not in set(touched)} | written
            before[name] = written
        for name, df in (appended or {}).items():
            if df.isEmpty():
                continue
            folders = before[name].get("", []) + self._write(name, df, False)[""]
            if len(folders) > MOST_FOLDERS:
                whole = self.spark.read.schema(schema.struct(schema.TABLES[name])).parquet(*[f"{self.root}/{f}" for f in folders])
                folders = self._write(name, whole, False)[""]
            before[name] = {"": folders}
        revision = self.revision + 1
        self._publish(revision, json.dumps({"version": schema.VERSION, "buckets": self.buckets, "tables": {t: f for t, f in before.items() if f}}, sort_keys=True))
        self.revision = revision
        return revision

    def _publish(self, revision: int, text: str) -> None:
        """A file appears under its final name complete, and only if no one else has published this revision."""
        hidden, final = self._path(f"snapshots/.{uuid.uuid4().hex}.json"), self._path(f"snapshots/{revision:012d}.json")
        out = self._fs.create(hidden, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(hidden, final):
            self._fs.delete(hidden, False)
            raise RuntimeError(f"snapshot {revision} was published by another writer")

    def vacuum(self, keep: int = 10) -> int:
        """Removes snapshots before the last `keep` and folders that no snapshot names. Returns the folders removed."""
        named: set[str] = set()
        for revision in range(1, self.revision + 1):
            if revision <= self.revision - keep:
                self._fs.delete(self._path(f"snapshots/{revision:012d}.json"), False)
            else:
                named |= {f.split("/")[1] for folders in self._snapshot(revision)["tables"].values() for fs in ([[folders]] if isinstance(folders, str) else folders.values()) for f in fs}
        gone = [s.getPath() for s in self._fs.listStatus(self._path("tables")) if s.getPath().getName() not in named]
        for folder in gone:
            self._fs.delete(folder, True)
        return len(gone)


def differing_copies(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Files below source whose copy below target is missing or differs in length or content: (name, length)."""

    def listed(root: str) -> DataFrame:
        base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        real = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath()
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        name = F.expr(f"substring_index(path, '{real}/', -1)")
        return files.select(name.alias("name"), "length", F.sha2("content", 256).alias("hash"))

    return listed(source).join(listed(target), ["name", "length", "hash"], "left_anti").select("name", "length")
