"""Substring dedup: words covered by a window of 20 words that starts earlier elsewhere go, by FM-indexes.

Windows reach the same shard by what they hold: of the 15 grams of 6 words in a window the one with the smallest hash is
its anchor, so equal windows have equal anchors. Consecutive windows with the same place of their anchor are a run, some
eight windows; a document is a list of runs (hashes and places, no words). Equal runs are one node with its first place:
what is not the first goes. Runs whose anchor no other run has are done. Only first runs that share an anchor with a
different run need their words: they are indexed, shard by shard, and streamed against the index.

A shard's index holds the Burrows-Wheeler transform of its runs in a wavelet tree (wavelet matrix of packed bits) and
the places of its suffixes. Backward search goes over all windows at once, a word a step; a window drops out when its
interval has one suffix, itself. What reaches 20 words has its first place by the smallest in the interval.

An anchor that very many different runs share (a frequent line in different surroundings) is split by window: a run's
windows become runs of one window, so equal ones meet again in one aggregate and no group grows with the corpus.

Words are compared as 64-bit hashes, runs and windows by two of them.

Defined results: null or empty text has no words and the hash of the empty text; a null doc_id is the smallest; rows that
agree in doc_id and text are the same document and leave each other alone; rows that agree in doc_id alone come in the
order of a hash of the text; documents with less than 20 words keep all; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ranges, slices

WINDOW, GRAM = 20, 6
ANCHORS = WINDOW - GRAM + 1
#: Different runs with one anchor beyond which they are split by window.
HOT = 4_096
#: Words of a shard's index.
SHARD_WORDS = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
#: Odd multipliers of the polynomial hashes over bytes and over words; their inverses undo a start.
_OF_BYTES, _OF_WORDS = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 16), base & ((1 << 64) - 1), np.uint64)
        factors[0] = 1
        have = _powers[base] = np.multiply.accumulate(factors)
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Polynomial:
    """Hashes of stretches of values: sums of value times power, moved to a common start."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _power(base, n), dtype=np.uint64)])
        self.back = _power(pow(base, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one text after the other, and how many each has."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.r_[True, ~inside[:-1]]))
    ends = np.flatnonzero(inside & (edge[1:] | np.r_[~inside[1:], True])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return Polynomial(_BYTES[data], _OF_BYTES).of(starts, ends), counts


class Runs:
    """The runs of a list of documents: document, first window and number of windows of each, anchor and content hash."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        ends = np.cumsum(counts)
        self.begin = ends - counts
        windows = np.maximum(counts - WINDOW + 1, 0)
        self.poly = Polynomial(words, _OF_WORDS)
        start = ranges(self.begin, windows)
        if not len(start):
            self.doc = self.start = self.n = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            return
        grams = np.arange(len(words) - GRAM + 1)
        value = self.poly.of(grams, grams + GRAM)
        least, at, width = value, grams, 1
        while width < ANCHORS:  # leftmost smallest of `width` grams
            step = min(width, ANCHORS - width)
            left, right = least[:-step], least[step:]
            at = np.where(left <= right, at[:-step], at[step:])
            least, width = np.minimum(left, right), width + step
        anchor = at[start]
        first = np.flatnonzero(np.r_[True, (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1])])
        self.start, self.n = start[first], np.diff(np.r_[first, len(start)])
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.anchor = value[anchor[first]]
        self.content = self.poly.of(self.start, self.start + self.n + WINDOW - 1)

    def place(self) -> np.ndarray:
        """First window within its document, and number of windows, as one number that sorts by the former."""
        return (self.start - self.begin[self.doc]) * 16 + self.n - 1


def unplaced(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place // 16, place % 16 + 1


# --- the index of a shard -----------------------------------------------------------------------------------------------


class WaveletMatrix:
    """Rank over a sequence of small integers, on packed bits with counts every 64."""

    def __init__(self, x: np.ndarray, symbols: int):
        self.levels = []
        for level in range(max(int(symbols - 1).bit_length(), 1) - 1, -1, -1):
            bit = (x >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            blocks = np.zeros(len(x) // 64 + 1, np.uint64)
            blocks.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)[:-1]])
            zeros = int(len(x) - bit.sum())
            self.levels.append((level, blocks, before.astype(np.int32), zeros))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        self.first = _beginnings(x, symbols)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] is among the first i[k]."""
        for level, blocks, before, zeros in self.levels:
            ones = before[i >> 6] + np.bitwise_count(blocks[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((c >> level) & 1, zeros + ones, i - ones)
        return i - self.first[c]


def _beginnings(bottom: np.ndarray, symbols: int) -> np.ndarray:
    """Where each symbol begins in the last level, where equal symbols stand together."""
    first = np.zeros(symbols, np.int64)
    at = np.flatnonzero(np.r_[True, bottom[1:] != bottom[:-1]])
    first[bottom[at]] = at
    return first


class FMIndex:
    """Index of a text of symbols 1.. with 0 between its parts, for patterns of up to 32 symbols."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        rank, k = text.astype(np.int64), 1
        while k < 32:  # suffixes in order of their first 32 symbols, which is all that shorter patterns can see
            key = rank * (n + symbols + 1)
            key[:-k] += rank[k:] + 1
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
            rank, k = new, 2 * k
        self.places = np.argsort(rank, kind="stable").astype(np.int32)
        self.tree = WaveletMatrix(text[self.places - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])

    def matches(self, text: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search for text[start : start + length] of all starts. Returns how many symbols from its end each
        pattern has in common with another place (its matching statistic, up to length), and the interval of those that
        have all."""
        statistic = np.zeros(len(start), np.int64)
        c = text[start + length - 1]
        low, high = self.before[c], self.before[c + 1]
        live = np.arange(len(start))
        for step in range(1, length + 1):
            more = high - low > 1
            live, low, high = live[more], low[more], high[more]
            statistic[live] = step
            if step < length and len(live):
                c = text[start[live] + length - 1 - step]
                low, high = self.before[c] + self.tree.rank(c, low), self.before[c] + self.tree.rank(c, high)
        full = np.zeros((2, len(start)), np.int64)
        full[:, live] = low, high
        return statistic, full[0], full[1]

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place in each interval."""
        starts, back = np.unique(low, return_inverse=True)
        ends = np.zeros(len(starts), np.int64)
        ends[back] = high
        cuts = np.stack([starts, ends], axis=1).ravel()
        return np.minimum.reduceat(np.r_[self.places, np.iinfo(np.int32).max], cuts)[::2][back]


def repeated_in(runs: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    """For each run (its words; n windows) the offsets of windows that an earlier run holds. The runs come in the order
    of their anchors, those of one anchor in the order of their places."""
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    ends = np.cumsum(lengths + 1)
    begin = ends - lengths - 1
    _, code = np.unique(np.concatenate(runs), return_inverse=True)
    symbols = int(code.max()) + 2
    text = np.zeros(int(ends[-1]), np.int64)
    text[ranges(begin, lengths)] = code + 1
    index = FMIndex(text, symbols)
    starts, run = ranges(begin, n), np.repeat(np.arange(len(runs)), n)
    statistic, low, high = index.matches(text, starts, WINDOW)
    full = np.flatnonzero(statistic == WINDOW)
    later = full[index.earliest(low[full], high[full]) < starts[full]] if len(full) else full
    out: list[np.ndarray] = [starts[:0]] * len(runs)
    cuts = np.flatnonzero(np.r_[True, run[later][1:] != run[later][:-1]]) if len(later) else []
    for a, b in zip(cuts, [*cuts[1:], len(later)], strict=True):
        r = run[later[a]]
        out[r] = starts[later[a:b]] - begin[r]
    return out


# --- passes over the documents ------------------------------------------------------------------------------------------


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")


def _anchors(docs: DataFrame) -> DataFrame:
    """h, c: anchors of the runs and their number in a slice of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, c = np.unique(Runs(*words_of(part.column("text"))).anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(h), pa.array(c)], names=["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long")


def _runs(docs: DataFrame) -> DataFrame:
    """h, g, doc_id, tkey, place: anchor, content and place of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                r = Runs(*words_of(part.column("text")))
                keys = [part.column(c).take(pa.array(r.doc)) for c in ("doc_id", "tkey")]
                yield pa.RecordBatch.from_arrays([_signed(r.anchor), _signed(r.content), *keys, pa.array(r.place())], names=["h", "g", "doc_id", "tkey", "place"])

    return docs.mapInArrow(run, "h long, g long, doc_id long, tkey long, place long")


def _with_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, doc_id, tkey, place, words of runs to be indexed; of runs with a hot anchor one row a window with its hash g
    and no words. wanted: doc_id, tkey, runs (place, h, hot) of a document."""
    rows = docs.join(wanted.withColumnsRenamed({"doc_id": "_d", "tkey": "_t"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tkey") == F.col("_t"))).select("doc_id", "tkey", "text", "runs")
    arrow = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("doc_id", pa.int64()), ("tkey", pa.int64()), ("place", pa.int64()), ("words", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in slices(batch):
                words, counts = words_of(part.column("text"))
                poly, begin = Polynomial(words, _OF_WORDS), np.cumsum(counts) - counts
                out = {c: [] for c in arrow.names}
                for at, key, runs in zip(begin.tolist(), zip(part.column("doc_id").to_pylist(), part.column("tkey").to_pylist(), strict=True), part.column("runs"), strict=True):
                    if key == last:  # a repeated row
                        continue
                    last, flat = key, runs.values
                    place, h, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("place", "h", "hot"))
                    start, n = unplaced(place)
                    cold = np.flatnonzero(~hot)
                    size = n[cold] + WINDOW - 1
                    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
                    single = ranges(start[hot], n[hot])
                    out["h"] += [h[cold], np.repeat(h[hot], n[hot])]
                    out["g"] += [np.zeros(len(cold), np.int64), poly.of(at + single, at + single + WINDOW).view(np.int64)]
                    out["place"] += [place[cold], single * 16]
                    out["doc_id"].append((key[0], len(cold) + len(single)))
                    out["tkey"].append(np.full(len(cold) + len(single), key[1], np.int64))
                    out["words"] += [pa.ListArray.from_arrays(pa.array(ends), _signed(words[ranges(at + start[cold], size)])), pa.nulls(len(single), pa.list_(pa.int64()))]
                if out["h"]:
                    ids = pa.array([d for d, m in out["doc_id"] for _ in range(m)], pa.int64())
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(out[c])) for c in ("h", "g")), ids, *(pa.array(np.concatenate(out[c])) for c in ("tkey", "place")), pa.concat_arrays(out["words"])], schema=arrow)

    return rows.mapInArrow(run, "h long, g long, doc_id long, tkey long, place long, words array<long>")


def _indexed(runs: DataFrame) -> DataFrame:
    """doc_id, tkey, place of windows that an earlier run of the same anchor holds."""
    names = ["h", "doc_id", "tkey", "place"]

    def found(group: list[tuple], words: list[np.ndarray]) -> pa.RecordBatch:
        start, n = unplaced(np.array([k[3] for k in group], np.int64))
        rows = []
        for key, at, offsets in zip(group, start.tolist(), repeated_in(words, n), strict=True):
            if len(offsets):
                cut = np.flatnonzero(np.r_[True, np.diff(offsets) != 1])
                rows += [(key[1], key[2], (at + int(offsets[a])) * 16 + b - a - 1) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(offsets)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["doc_id", "tkey", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        words: list[np.ndarray] = []
        size = 0
        for batch in batches:
            lists = batch.column("words")
            offsets, flat = np.asarray(lists.offsets), lists.values.to_numpy().view(np.uint64)
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if group and key == group[-1]:  # a repeated row of a document
                    continue
                if size >= SHARD_WORDS and key[0] != group[-1][0]:  # whole anchors only
                    yield found(group, words)
                    group, words, size = [], [], 0
                group.append(key)
                words.append(flat[offsets[i] : offsets[i + 1]].copy())
                size += len(words[-1])
        if group:
            yield found(group, words)

    sharded = runs.select(*names, "words").repartition("h").sortWithinPartitions("h", F.asc_nulls_first("doc_id"), "tkey", "place")
    return sharded.mapInArrow(run, "doc_id long, tkey long, place long")


_KEY = ("doc_id", "tkey", "place")


def _first(runs: DataFrame) -> DataFrame:
    """h, g, first: the first place of equal runs."""
    return runs.groupBy("h", "g").agg(F.min(F.struct(*_KEY)).alias("first"), F.count("*").alias("places"))


def _not_first(runs: DataFrame, first: DataFrame) -> DataFrame:
    return runs.join(first.where("places > 1").select("h", "g", "first"), ["h", "g"]).where(~F.struct(*_KEY).eqNullSafe(F.col("first"))).select(*_KEY)


def marks(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, tkey, place of all runs of windows that start earlier elsewhere."""
    own = _keyed(docs)
    shared = materialise(_anchors(own).groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h"), "anchors")
    found = materialise(_runs(own).join(shared, "h").select("h", "g", *_KEY), "runs")
    first = materialise(_first(found), "first-runs")
    kinds = first.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = first.join(kinds, "h").select(F.col("first.doc_id").alias("doc_id"), F.col("first.tkey").alias("tkey"), F.struct(F.col("first.place").alias("place"), "h", (F.col("kinds") > hot).alias("hot")).alias("run"))
    wanted = wanted.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    words = materialise(_with_words(own, wanted), "words")
    windows = words.where("words is null").select("h", "g", *_KEY)
    return _not_first(found, first).unionByName(_indexed(words.where("words is not null"))).unionByName(_not_first(windows, _first(windows)))


def kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs, without the words that marks() cover."""
    own = _keyed(docs)
    by_doc = found.groupBy(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t")).agg(F.collect_set("place").alias("places"))
    rows = own.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tkey") == F.col("_t")), "left").select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc_id, text, places in zip(part.column("doc_id").to_pylist(), part.column("text"), part.column("places"), strict=True):
                    words = (text.as_py() or "").encode().split()
                    stay = words
                    if places.is_valid:
                        start, n = unplaced(places.values.to_numpy())
                        cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + n + WINDOW - 1, -1)
                        stay = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                    out.append((doc_id, len(words), len(words) - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of docs (doc_id, text)."""
    return kept(docs, materialise(marks(docs, hot), "repeated-windows"))
