"""Language-model scores by prediction by partial matching.

A text is modelled as its token sequence: words (lower-cased A-Z) joined by single blanks, then an end symbol, byte by
byte. The model is a trie of byte contexts up to ORDER with counts learnt from the training documents. A symbol that
the longest known context has not seen is reached by escapes (method D: half a count for each distinct symbol) to ever
shorter contexts, where symbols of the longer context are excluded. The symbols of a context are always among
those of its shorter one, so all exclusions are numbers of a context alone and code lengths come from table lookups.

The trie grows with the corpus and is never held in one place: tasks pre-aggregate (context, symbol) counts; these meet
the pre-aggregated questions of blocks of documents in buckets of contexts; answers return to their block. Only the
tables of contexts of up to two bytes, at most 2^24 entries, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Longest context in bytes; contexts up to LOW bytes are broadcast.
ORDER, LOW = 5, 2
#: Byte values that UTF-8 never has: before the text, and its end. Symbols that can follow: 0 to 255.
BEFORE, END, ALPHABET = 0xFE, 0xFF, 256
#: Text bytes of a block of documents; least number of buckets of contexts.
BLOCK_BYTES, BUCKETS = 24 << 20, 1_024


def tokens_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def grams(texts: list[list[bytes]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of the texts the packed (context, symbol), and the number of symbols of each text."""
    pad = bytes([BEFORE]) * order
    joined = [b" ".join(t) for t in texts]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined)) + 1
    flat = np.frombuffer(b"".join([pad + t + b"\xff" for t in joined]), np.uint8).astype(np.int64)
    packed = np.zeros(max(len(flat) - order, 0), np.int64)
    for j in range(order + 1):
        packed = (packed << 8) | flat[j : j + len(packed)]
    keep = np.ones(len(packed), bool)  # windows that begin in one text and end in the next
    ends = np.cumsum(sizes + order)[:-1] - order
    keep[(ends[:, None] + np.arange(order)).ravel()] = False
    return packed[keep], sizes


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of n (or their number)."""
    if n is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[starts], np.diff(np.append(starts, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(n, starts) if len(starts) else n[:0]


class Level:
    """Contexts of one length with the counts of their symbols; below is the next shorter level."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int, below: Level | None):
        self.keys, self.n = keys, n
        context = keys >> 8
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[starts]
        self.total = np.add.reduceat(n, starts) if len(starts) else n[:0]
        self.distinct = np.diff(np.append(starts, len(keys)))
        # what this context's symbols count in the shorter context: the exclusion there
        if below is None:
            self.excluded = np.zeros(len(starts), np.int64)
        else:
            there = below.n[np.searchsorted(below.keys, keys & ((1 << 8 * order) - 1))]
            self.excluded = np.add.reduceat(there, starts) if len(starts) else there


def levels(keys: np.ndarray, n: np.ndarray, top: int, bottom: int, below: Level | None = None) -> list[Level]:
    """The levels from bottom to top from the sorted counts of the top level."""
    tables = {top: (keys, n)}
    for k in range(top - 1, bottom - 1, -1):
        tables[k] = summed(tables[k + 1][0] & ((1 << 8 * (k + 1)) - 1), tables[k + 1][1])
    out = []
    for k in range(bottom, top + 1):
        below = Level(*tables[k], k, below)
        out.append(below)
    return out


def code_lengths(questions: np.ndarray, tries: list[Level]) -> np.ndarray:
    """log10 probability of each (context, symbol); tries: the levels from 0 to ORDER."""
    out = np.zeros(len(questions))
    open_ = np.arange(len(questions))
    gone_n, gone_d = np.zeros(len(questions)), np.zeros(len(questions))  # exclusions by the longer context
    for k in range(len(tries) - 1, -1, -1):
        level, key = tries[k], questions[open_] & ((1 << 8 * (k + 1)) - 1)
        if not len(level.keys) or not len(open_):
            continue
        at = np.minimum(np.searchsorted(level.contexts, key >> 8), len(level.contexts) - 1)
        known = level.contexts[at] == key >> 8
        total, distinct = level.total[at] - gone_n[open_], level.distinct[at] - gone_d[open_]
        spot = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
        found = level.keys[spot] == key
        escapes = known & ~found & (distinct > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(found, level.n[spot] - 0.5, 0.5 * distinct) / total
            out[open_] += np.where(found | escapes, np.log10(step), 0.0)
        gone_n[open_] = np.where(known, level.excluded[at], gone_n[open_])
        gone_d[open_] = np.where(known, level.distinct[at], gone_d[open_])
        open_ = open_[~found]
    out[open_] -= np.log10(np.maximum(ALPHABET - gone_d[open_], 1))
    return out


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens)).view(np.int64)


class Lookup:
    """Values of int64 keys by hashing into tables of row numbers; what collides goes to the next table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.tables = keys, values, []
        rest = np.arange(len(keys), dtype=np.int32)
        self.bits = max(8, int(len(keys)).bit_length() + 1)
        while len(rest):
            shift, table = len(self.tables), np.full(1 << self.bits, -1, np.int32)
            table[self._slot(keys[rest], shift)] = rest
            self.tables.append(table)
            rest = rest[table[self._slot(keys[rest], shift)] != rest]

    def _slot(self, keys: np.ndarray, number: int) -> np.ndarray:
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * number + 1)) & (1 << 64) - 1)
        return ((keys.view(np.uint64) * factor) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, which must all be known."""
        at = self.tables[0][self._slot(keys, 0)] if self.tables else np.zeros(0, np.int32)
        for number in range(1, len(self.tables)):
            wrong = np.flatnonzero(self.keys[at] != keys)
            if not len(wrong):
                break
            at[wrong] = self.tables[number][self._slot(keys[wrong], number)]
        return self.values[at]


class Counts:
    """Sums of keys over a task, condensed as they come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(summed(keys))
        if len(self.parts) >= 8:
            self.parts = [self.total()]

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))


#: Kinds of counted keys: words (hashes), contexts of LOW bytes with their symbol, bytes of text.
WORDS, SHORT, BYTES = 0, 1, 2


def _counted(docs: DataFrame) -> DataFrame:
    """kind, key, n summed over tasks: words and short contexts of the training rows, bytes of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, short, size = Counts(), Counts(), 0
        for batch in batches:
            for part in common.slices(batch, most=common.COUNTED_BYTES):
                texts = common.texts_of(part)
                size += sum(len(t.encode()) for t in texts)
                lists = [tokens_of(t) for t, held in zip(texts, part.column("held_out").to_pylist(), strict=True) if not held]
                words.add(hashes([w for t in lists for w in t] + [b"\n"] * len(lists)))  # no word is a line feed: the end
                short.add(grams(lists, LOW)[0])
        for kind, (keys, n) in ((WORDS, words.total()), (SHORT, short.total()), (BYTES, (np.zeros(1, np.int64), np.array([size])))):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    return docs.select("text", "held_out").mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs; learns from the rows
    that are not held out.

    A null or blank text has one token, the end. Null ids and repeated rows take part as rows of their own. With
    nothing to learn from, the model is uniform over symbols. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    counted = common.materialise(_counted(docs), "counts")
    facts = {r["kind"]: r for r in counted.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    vocabulary, train_tokens = (facts[WORDS]["rows"], facts[WORDS]["n"]) if WORDS in facts else (0, 0)
    blocks = max(1, -(-int(facts[BYTES]["n"] if BYTES in facts else 0) // BLOCK_BYTES))
    buckets = max(BUCKETS, 16 * blocks)
    low = counted.where(F.col("kind") == SHORT).select("key", "n").orderBy("key").toPandas()  # at most 2^24 rows
    shipped = docs.sparkSession.sparkContext.broadcast((low["key"].to_numpy(np.int64), low["n"].to_numpy(np.int64)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counts()
        for batch in batches:
            for part in common.slices(batch, most=common.COUNTED_BYTES):
                seen.add(grams([tokens_of(t) for t in common.texts_of(part)])[0])
        keys, n = seen.total()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), SHORT, np.int8)), pa.array(keys), pa.array(n)], ["kind", "key", "n"])

    # contexts that share their last LOW + 1 bytes have one bucket, so all contexts that a question can fall back to do
    last = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1))
    bucket = F.pmod(F.shiftright(F.xxhash64("kind", F.when(F.col("kind") == WORDS, F.col("key")).otherwise(last)), 7), F.lit(buckets)).cast("int")
    learnt = docs.where(~F.col("held_out")).select("text").mapInArrow(learn, "kind byte, key long, n long")
    learnt = learnt.unionByName(counted.where(F.col("kind") == WORDS)).withColumn("bucket", bucket)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("text", "doc_id"), F.lit(blocks)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        block, words, asked = table.column("block")[0].as_py(), Counts(), Counts()
        for batch in table.to_batches():
            for part in common.slices(batch, most=common.COUNTED_BYTES):
                lists = [tokens_of(t) for t in common.texts_of(part)]
                words.add(hashes([w for t in lists for w in t] + [b"\n"]))
                asked.add(grams(lists)[0])
        w, g = words.total()[0], asked.total()[0]
        kind = np.repeat(np.array([WORDS, SHORT], np.int8), [len(w), len(g)])
        return pa.table({"block": pa.array(np.full(len(kind), block, np.int32)), "kind": pa.array(kind), "key": pa.array(np.concatenate([w, g]))})

    asked = dealt.groupBy("block").applyInArrow(ask, "block int, kind byte, key long").withColumn("bucket", bucket)

    def answer(model: pa.Table, questions: pa.Table) -> pa.Table:
        get = lambda t, c: t.column(c).to_numpy()
        out = {"block": [], "kind": [], "key": [], "value": []}
        for kind in (WORDS, SHORT):
            mine, theirs = get(model, "kind") == kind, get(questions, "kind") == kind
            if not theirs.any():
                continue
            keys, n = summed(get(model, "key")[mine], get(model, "n")[mine])
            want, place = np.unique(get(questions, "key")[theirs], return_inverse=True)
            if kind == WORDS:
                at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
                value = np.where(keys[at] == want, n[at], 0).astype(float) if len(keys) else np.zeros(len(want))
            else:
                short = levels(*shipped.value, LOW, 0)
                value = code_lengths(want, [*short, *levels(keys, n, ORDER, LOW + 1, short[-1])])
            out["block"].append(get(questions, "block")[theirs])
            out["kind"].append(np.full(int(theirs.sum()), kind, np.int8))
            out["key"].append(get(questions, "key")[theirs])
            # counts stay whole; code lengths need no more than single precision, whose zero bits travel packed
            out["value"].append(value[place] if kind == WORDS else value[place].astype(np.float32).astype(np.float64))
        types = {"block": pa.int32(), "kind": pa.int8(), "key": pa.int64(), "value": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], types[c]) for c, v in out.items()})

    answers = learnt.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, "block int, kind byte, key long, value double")
    divisor = float(np.log10(train_tokens + vocabulary + 1))

    def add_up(texts: pa.Table, known: pa.Table) -> pa.Table:
        kind, key, value = (known.column(c).to_numpy() for c in ("kind", "key", "value"))
        words = Lookup(key[kind == WORDS], value[kind == WORDS])
        trie = Lookup(key[kind == SHORT], value[kind == SHORT])
        out = []
        for batch in texts.to_batches():
            for part in common.slices(batch, most=common.COUNTED_BYTES):
                lists = [tokens_of(t) for t in common.texts_of(part)]
                size = np.fromiter(map(len, lists), np.int64, len(lists)) + 1
                count = words.get(hashes([w for t in lists for w in (*t, b"\n")]))
                packed, symbols = grams(lists)
                arrays = [
                    part.column("doc_id"), part.column("held_out"), pa.array(size), pa.array(common.split_sums((count > 0).astype(np.int64), size)),
                    pa.array(common.split_sums(np.log10(count + 1), size) - size * divisor), pa.array(common.split_sums(trie.get(packed), symbols)),
                ]
                out.append(pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
