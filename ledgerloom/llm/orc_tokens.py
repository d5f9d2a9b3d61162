"""Token ids as ORC files: run-length encoded integers, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.staging import drop_at_exit

from . import common

#: Writer settings. ORC stores integers of a stripe run-length encoded; a row index entry covers STRIDE documents.
STRIDE = 1_000
OPTIONS = {
    "compression": "lz4", "orc.create.index": "true", "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(32 << 20),
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}

#: Characters of words that a worker keeps.
CACHE_CHARS = 7 << 20

_caches: dict[str, common.FlatCache] = {}


def word_cache(path: str) -> common.FlatCache:
    """Ids of words by the tokenizer file, one cache for each worker. Words are what stands between spaces and line
    feeds: the tokenizer drops white space and neither its splits nor its merges reach across it."""
    if path not in _caches:
        common.one_thread()
        import tokenizers

        model = tokenizers.Tokenizer.from_file(path)
        _caches[path] = common.FlatCache(lambda words: _encode_words(model, words), limit=CACHE_CHARS)
    return _caches[path]


def _encode_words(model, words: list[str], at_once: int = 4_000) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, many words in a call: token offsets tell which word a token belongs to."""
    ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), at_once):  # an encoding takes a few hundred bytes a token: few at a time
        own = words[i : i + at_once]
        x = model.encode(" ".join(own), add_special_tokens=False)
        ids.append(np.array(x.ids, np.int64))
        begins = np.fromiter(chain.from_iterable(x.offsets), np.int64, 2 * len(ids[-1]))[::2]
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        sizes.append(np.diff(np.searchsorted(begins, ends), prepend=0))
    return np.concatenate(ids), np.concatenate(sizes)


def encode_texts(texts: list[str], path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each followed by end_id; the number of ids of each."""
    cache = word_cache(path)
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if "<|" not in text:  # the tokenizer lower-cases, but for its special strings
            text = text.encode().lower().decode()
        own = text.replace("\n", " ").split(" ")
        words += own
        counts[i] = len(own)
    rows = cache.rows(words)
    n = common.split_sums(cache.size[rows], counts)
    ids = np.insert(cache.ids(rows), np.cumsum(n), end_id).astype(np.int32)
    return ids, n + 1


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes one row for each row of docs in ascending doc_id order (null first; equal ids by text), into files that
    cover consecutive ranges. Columns: doc_id, n_tokens, local_start (ids before it in its file), ids.

    Null texts are empty: they get end_id only. An empty table writes a file without rows or no file.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            for part in common.slices(batch, most=common.COUNTED_BYTES):
                ids, n = encode_texts(common.texts_of(part), tokenizer, end_id)
                ends = np.cumsum(n)
                arrays = [part.column("doc_id"), pa.array(n), pa.array(before + ends - n), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))]
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "local_start", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(encode, "doc_id long, n_tokens long, local_start long, ids array<int>").write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with doc_ids only theirs: row indexes and Bloom filters then skip stripes and row groups."""
    rows = spark.read.schema("doc_id long, n_tokens long, local_start long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digest(stored: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every stored row.

    Each stripe is read by itself. The ids are reduced to a checksum where they are read; a file's first position
    is the sum of the files before it, one row for each file.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
            kept = [batch.column(c) for c in ("file", "doc_id", "local_start")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    located = stored.select(F.col("_metadata.file_path").alias("file"), "doc_id", "local_start", "ids", "n_tokens")
    files = located.groupBy("file").agg(F.min("doc_id").alias("first_id"), F.sum("n_tokens").alias("n"))
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    rows = located.drop("n_tokens").mapInArrow(check, "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encodes docs, writes the files to the shared folder, reads them back and returns digest()."""
    path = common.shared_path(docs.sparkSession, "token-orc")
    write_tokens(docs, path, tokenizer, end_id)
    drop_at_exit(docs.sparkSession, path)
    return digest(read_tokens(docs.sparkSession, path))
