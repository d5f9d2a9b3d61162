"""What the operators of this subpackage share: tables, shared storage, bounded text slices."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.staging import drop_at_exit, shared_folder

# Batches of texts come and go in a worker that lives on: what is freed shall go back to the system.
pa.set_memory_pool(pa.system_memory_pool())

#: A word in the sense of the contracts: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Upper and lower case of ASCII, for translate(): the contracts lower-case A-Z alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of ids that may be broadcast (some 30 bytes each); beyond, joins are shuffled.
MOST_BROADCAST = 500_000
#: Text bytes that one Python step holds at a time, and where a step sorts what it has counted; longer single texts are
#: taken alone.
SLICE_BYTES, COUNTED_BYTES = 512 << 10, 2 << 20
#: Rows of documents that Spark hands to Python at a time in the queries and the pipeline.
TEXT_ROWS = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors all see: below spark.checkpoint.dir if that is set."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts lineage, survives lost executors.
    options are those of the writer."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    drop_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """For the rest of the session: batches of documents, which can be long, have TEXT_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While tables are written within: rows that Spark hands to Python at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keyed_rows(docs: DataFrame, chosen: DataFrame, repeated: bool, key: tuple[str, ...] = ("text",)) -> DataFrame:
    """The rows of docs whose id and hash of the key columns are in chosen (_id_, _hash_, ...), with chosen's other columns.

    chosen is broadcast if it is small by count. Texts move only if it is not, or if docs has repeated rows, of which
    one stays.
    """
    rows = docs.withColumn("_own_", F.xxhash64(*key))
    few = chosen.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    on = rows["doc_id"].eqNullSafe(chosen["_id_"]) & (rows["_own_"] == chosen["_hash_"])
    rows = rows.join(F.broadcast(chosen) if few else chosen, on)
    return rows.dropDuplicates(["doc_id", "_own_"]) if repeated else rows


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or with `row.name` a field of the struct `row`."""
    outer, _, inner = name.partition(".")
    return batch.column(outer).field(inner) if inner else batch.column(outer)


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batch whose texts have about `most` bytes at most; a longer single text makes a part of its own."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column(batch, name)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in column(batch, name).to_pylist()]


class FlatCache:
    """Per-worker map from a piece of text to its ids, kept as flat arrays so that whole batches are assembled by numpy.

    encode takes a list of distinct pieces and returns their ids one after the other and how many each has. Holds about
    `limit` characters of keys; beyond that it keeps what was asked for again since the last time.
    """

    #: The cache that this worker used last: workers serve many stages, but only one cache is kept filled.
    filled: FlatCache | None = None

    def __init__(self, encode, limit: int = 2 << 20):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = self.used = self.n = 0
        self.start, self.size, self.hits = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.flat = np.zeros(4096, np.int32)

    def _shrink(self) -> None:
        pieces = list(self.index)
        keep = np.flatnonzero(self.hits[: self.n] > 1)
        if (chars := sum(len(pieces[i]) for i in keep)) > self.limit // 2:
            return self.clear()
        flat, size = self.ids(keep), self.size[keep]
        self.flat[: len(flat)], self.size[: len(keep)], self.start[: len(keep)] = flat, size, np.cumsum(size) - size
        self.hits[:] = 0
        self.index = {pieces[i]: k for k, i in enumerate(keep.tolist())}
        self.n, self.used, self.chars = len(keep), len(flat), chars

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _learn(self, pieces: list[str]) -> None:
        ids, sizes = self.encode(pieces)
        total = len(ids)
        self._room("start", self.n + len(pieces))
        self._room("size", self.n + len(pieces))
        self._room("hits", self.n + len(pieces))
        self._room("flat", self.used + total)
        self.size[self.n : self.n + len(pieces)] = sizes
        self.start[self.n : self.n + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = ids
        self.index.update(zip(pieces, range(self.n, self.n + len(pieces)), strict=True))
        self.n += len(pieces)
        self.used += total
        self.chars += sum(map(len, pieces))

    def rows(self, pieces: list[str]) -> np.ndarray:
        """A row number for each piece, valid until the next call."""
        if FlatCache.filled is not self:
            if FlatCache.filled is not None:
                FlatCache.filled.clear()
            FlatCache.filled = self
        if self.chars > self.limit:
            self._shrink()
        got = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(missing := np.flatnonzero(got < 0)):
            new = [pieces[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(new)))
            got[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        self.hits[: self.n] += np.bincount(got, minlength=self.n).astype(np.int32)
        return got

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of these rows, one after the other."""
        return gather(self.flat, self.start[rows], self.size[rows])


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """What a FlatCache's encode returns, from a list of id lists."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (size[i] numbers) for all i, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - size), size) + np.arange(total)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + size[i]] for all i, one after the other."""
    return flat[ranges(start, size)]


def split_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of values; counts has the length of each stretch (may be 0)."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def one_thread() -> None:
    """Spark places the work; libraries in a task use that task's core only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
