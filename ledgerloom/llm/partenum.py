"""N-gram Jaccard join by PartEnum signatures.

Sets of word 5-grams are compared; J >= 3/4. Sizes are cut into bands such that similar sets lie in the same or in
adjacent bands. An instance j serves the pairs of band j-1 with bands j-1 and j: their symmetric difference has at
most k(j) elements. PartEnum hashes the feature domain into n1 parts of n2 subparts and signs subsets of subparts:

- small k(j): n1 = k(j) // 2 + 1 parts of three subparts. Of two similar sets one part at least has an error in one
  subpart at most; all subsets of two subparts of each part are enumerated, so one of them is common.
- large k(j): n1 > k(j) parts of one subpart. A set signs the k + 1 parts whose contents come first in one order of all
  contents, k being what its own size permits. Of two similar sets take the one whose last signed content comes
  earlier in the order: one of its k + 1 parts is free of errors, and the other set has that content and signs it too.
  The order puts contents with a rare shingle first (counts of hashed shingles over all documents), so passages that
  many documents share hardly ever make candidates.

Equal sets are one node from the start, so copies are never paired. Groups of a signature up to SMALL members give
their pairs, larger ones a star to their first member; a lower bound of the difference from small count sketches drops
most. Where a large group is not one cluster of possible pairs then, its members are compared by sketches in blocks
and give the few edges that join what is possible. Clusters only say which sets meet: within each cluster all sets are
compared exactly, in blocks, and every link is counted. Links become classes by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a shingle; similarity NUM / DEN.
SHINGLE, NUM, DEN = 5, 3, 4
#: Up to this k subsets of two of three subparts are enumerated; beyond, parts for each permitted difference.
ENUMERATED, PARTS_PER_K = 8, 1.35
#: Cells of the table of shingle counts, and slices in which tasks' tables are summed.
CELLS, CELL_SLICES = 1 << 20, 64
#: Largest group that gives its pairs; members of a large group, and of a cluster, that are compared in one block.
SMALL, SKETCHED, COMPARED = 32, 2_048, 384
#: Rows that Spark hands to Python at a time: texts can be long.
TEXTS = 1_000
#: Signatures that a task sorts at a time; signatures of one bucket, about; signatures for each shingle of a set,
#: about; bits of a signature beyond those that tell the expected number apart.
CHUNK, BUCKET_ROWS, PER_SHINGLE, SPARE = 1_500_000, 750_000, 0.65, 13
#: Sets of clusters in one block that are compared by one call, about.
UNIT = 1_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64)) for j in range(SHINGLE)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word 5-grams (of its whole sequence where there are fewer words),
    one text after the other, and the number of each text."""
    lists = [t.encode().lower().split() for t in texts]  # bytes: ASCII letters are lowered, ASCII white space splits
    words = np.fromiter(map(len, lists), np.int64, len(lists))
    h = np.fromiter((xxhash.xxh64_intdigest(w) for x in lists for w in x), np.uint64, int(words.sum()))
    size = np.where(words >= SHINGLE, words - SHINGLE + 1, (words > 0).astype(np.int64))
    mixed = mix(h)
    total = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
    for j in range(SHINGLE):
        total += mixed[j : j + len(total)] * _POWERS[j]
    first = np.cumsum(words) - words
    long_ = words >= SHINGLE
    out = np.zeros(int(size.sum()), np.uint64)
    at = np.cumsum(size) - size
    out[common.ranges(at[long_], size[long_])] = mix(total[common.ranges(first[long_], size[long_])])
    for i in np.flatnonzero((words > 0) & ~long_).tolist():
        out[at[i]] = mix(np.array([(h[first[i] : first[i] + words[i]] * np.array(_POWERS[: words[i]])).sum() + np.uint64(words[i])]))[0]
    for a, b in zip(at.tolist(), (at + size).tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[size > 0]] = True
    return out[new], common.split_sums(new.astype(np.int64), size)


def shingles(text: str) -> np.ndarray:
    """The set of one text."""
    return shingle_sets([text])[0]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of 64-bit integers over consecutive stretches, modulo 2^64."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def set_keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit names of sets: equal sets have equal names."""
    return (_sums(mix(flat ^ _M1), sizes) ^ sizes.astype(np.uint64)).view(np.int64)


def band_starts(most: int = 1 << 40) -> np.ndarray:
    """First size of each band; a band ends at DEN/NUM times its first size."""
    starts = [1]
    while starts[-1] < most:
        starts.append(DEN * starts[-1] // NUM + 1)
    return np.array(starts)


_BANDS = band_starts()
#: k(j): elements in which similar sets of band j-1 and band j-1 or j differ at most.
_MOST = np.array([0, *((r + DEN * r // NUM) * (DEN - NUM) // (DEN + NUM) for r in (_BANDS[1:] - 1).tolist())])
#: First-level parts of instance j.
_PARTS = np.where(_MOST <= ENUMERATED, _MOST // 2 + 1, (PARTS_PER_K * (_MOST + 1)).astype(np.int64) + 2)


def signatures(flat: np.ndarray, sizes: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets (sorted distinct 64-bit values, one set after the other) and the set of each signature.

    rarity: small numbers for the cells of rare shingles; any table serves, if it is the same for all sets."""
    band = np.searchsorted(_BANDS, sizes, side="right") - 1
    rare = rarity[(flat >> np.uint64(11)) & np.uint64(len(rarity) - 1)]
    sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for upper in (False, True):
        j = np.maximum(band + (not upper), 0)
        # as the larger of a pair: partners up to the end of the band below; else up to DEN/NUM times the size
        own = (sizes + (_BANDS[j] - 1 if upper else DEN * sizes // NUM)) * (DEN - NUM) // (DEN + NUM)
        signing = (sizes > 0) & (_MOST[j] > 0) & (own > 0)
        few = signing & (_MOST[j] <= ENUMERATED)
        for some, subparts in ((few, 3), (signing & ~few, 1)):
            sets = np.flatnonzero(some)
            if not len(sets):
                continue
            elements = common.ranges(np.cumsum(sizes)[sets] - sizes[sets], sizes[sets])
            parts = _PARTS[j[sets]] * subparts
            base = np.cumsum(parts) - parts
            seed = mix((j[sets] * 7_919 + 1_000_003).astype(np.uint64))
            x = flat[elements]
            place = np.repeat(base, sizes[sets]) + (mix(x ^ np.repeat(seed, sizes[sets])) % np.repeat(parts, sizes[sets]).astype(np.uint64)).astype(np.int64)
            content = np.zeros(int(parts.sum()), np.uint64)
            np.add.at(content, place, mix(x))
            number = common.ranges(np.zeros(len(parts), np.int64), parts).astype(np.uint64)
            name = np.repeat(seed, parts) + _M1 * number
            if subparts == 3:
                one, two = content.reshape(-1, 3)[:, [1, 2, 0]].ravel(), content.reshape(-1, 3)[:, [2, 0, 1]].ravel()
                sigs.append(mix(mix(one + name) + two * _M2))
                owners.append(np.repeat(sets, parts))
                continue
            most = np.full(len(content), 255, np.uint8)  # an empty part comes last
            np.minimum.at(most, place, rare[elements])
            name = mix(content + name)
            order = (most.astype(np.uint64) << np.uint64(56)) | (name >> np.uint64(8))
            last = np.fromiter((np.partition(order[a : a + n], k)[k] for a, n, k in zip(base.tolist(), parts.tolist(), own[sets].tolist(), strict=True)), np.uint64, len(sets))
            signed = order <= np.repeat(last, parts)
            sigs.append(name[signed])
            owners.append(np.repeat(sets, parts)[signed])
    return np.concatenate(sigs), np.concatenate(owners)


def rough_cells(n: np.ndarray) -> np.ndarray:
    """Cells of the sketch of a set of n elements: a power of two, about half of n, from 64 to 1,024."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(n, 1) / 2 + 1)), 6, 10).astype(np.int64)


def sketches(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Elements in each of the hashed cells, up to 255: sums of differences bound the sets' difference from below."""
    cells = rough_cells(sizes)
    base = np.cumsum(cells) - cells
    place = np.repeat(base, sizes) + (mix(flat ^ _M2) & np.repeat(cells - 1, sizes).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(place, minlength=int(cells.sum())), 255).astype(np.uint8).tobytes()
    return [counts[a : a + n] for a, n in zip(base.tolist(), cells.tolist(), strict=True)]


def difference(x: bytes, y: bytes) -> int:
    """Lower bound of the difference of two sets by their sketches; the longer one is folded."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
    cells = min(len(a), len(b))
    return int(np.abs(a.reshape(-1, cells).sum(0) - b.reshape(-1, cells).sum(0)).sum())


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def node_rows(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), node (name of the set), n (its size), sketch; node is null for empty sets. Rows
    with a slice hold parts of a task's table of shingle counts instead: slice, counts."""
    names = ["doc_id", "key", "node", "n", "sketch", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in common.slices(batch):
                flat, sizes = shingle_sets(common.texts_of(part))
                np.add.at(seen, ((flat >> np.uint64(11)) & np.uint64(CELLS - 1)).astype(np.int64), 1)
                empty = pa.array(sizes == 0)
                node, rough = pa.array(set_keys(flat, sizes), mask=sizes == 0), pa.array(sketches(flat, sizes), pa.binary())
                arrays = [part.column("doc_id"), part.column("key"), node, pa.array(sizes), pc.if_else(empty, None, rough), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names)
        counts = [planes(x.astype(np.uint64)) for x in seen.reshape(CELL_SLICES, -1)]
        arrays = [*(pa.nulls(CELL_SLICES, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())), pa.array(np.arange(CELL_SLICES, dtype=np.int32)), pa.array(counts, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names)

    return _narrow(docs).withColumn("key", F.xxhash64("text")).mapInArrow(run, "doc_id long, key long, node long, n long, sketch binary, slice int, counts binary")


def planes(x: np.ndarray) -> bytes:
    """64-bit integers as planes of bytes, lowest first, as many as the largest needs: neighbours in a plane are alike."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((body.shape[1], 8), np.uint8)
    out[:, :width] = body.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def rarity_table(counts: DataFrame) -> np.ndarray:
    """From rows (slice, counts): for each cell a number from 0 to 254 that grows with the logarithm of its count over
    all documents, against the mean. CELLS numbers reach the driver, whatever the corpus."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // CELL_SLICES, np.uint64)
        for batch in table.to_batches():
            for x in batch.column("counts"):
                total += unplanes(x.as_py())
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([planes(total)], pa.binary())})

    pairs = counts.withColumn("salt", F.spark_partition_id() % 32)
    each = pairs.groupBy("slice", "salt").applyInArrow(lambda t: add(t), "slice int, counts binary")
    found = each.groupBy("slice").applyInArrow(lambda t: add(t), "slice int, counts binary").collect()  # CELL_SLICES rows
    total = np.zeros((CELL_SLICES, CELLS // CELL_SLICES))
    for r in found:
        total[r["slice"]] = unplanes(bytes(r["counts"]))
    over = total.ravel() / max(total.mean(), 1.0)  # a cell of rare shingles alone is near the mean on a large corpus
    return np.clip(np.log2(np.maximum(over, 0.5) * 2) * 12, 0, 254).astype(np.uint8)


def signature_rows(docs: DataFrame, rarity: np.ndarray, expected: int) -> DataFrame:
    """Signatures of all sets, packed: bucket, large, n, sigs, places, nodes. A row has sorted signatures of one bucket,
    as differences, and the places of their sets in a list of nodes. A task signs equal sets once.

    A signature keeps as many bits as `expected` has and SPARE more: unlike ones fall together about once in 2^SPARE
    signatures, which only adds candidates. Where more than SMALL sets of a chunk share a signature, they go to a row
    of their own (large, in any bucket) and only the first stands in the bucket, marked: a hot signature reaches its
    bucket once a chunk and not once a set.
    """
    bits = min(63, max(expected, 1).bit_length() + SPARE)
    buckets = max(8, -(-expected // BUCKET_ROWS))
    shipped = docs.sparkSession.sparkContext.broadcast(rarity)
    names = ["bucket", "large", "n", "sigs", "places", "nodes"]

    def packed(sig: np.ndarray, place: np.ndarray, nodes: np.ndarray, mark: np.ndarray, large: bool, turn: int) -> pa.RecordBatch:
        """Rows of sorted signatures. Places are doubled; odd ones are marked."""
        bucket = (sig >> np.uint64(max(bits - 40, 0))).astype(np.int64) * buckets >> min(bits, 40)
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket)).tolist()
        columns = [[], [], [], [], []]
        for a, b in zip([0, *ends], ends, strict=False):
            if a == b:
                continue
            used, own = np.unique(place[a:b], return_inverse=True)
            columns[0].append((int(bucket[a]) + turn) % buckets)
            columns[1].append(b - a)
            columns[2].append(planes(np.diff(sig[a:b], prepend=np.uint64(0))))
            columns[3].append(planes((2 * own + mark[a:b]).astype(np.uint64)))
            columns[4].append(nodes[used].tobytes())
        types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays([arrays[0], pa.array([large] * len(arrays[0]), pa.bool_()), *arrays[1:]], names)

    def chunk(sigs: list[np.ndarray], owners: list[np.ndarray], nodes: list[np.ndarray], turn: int) -> Iterator[pa.RecordBatch]:
        sig, place, nodes = np.concatenate(sigs), np.concatenate(owners).astype(np.int32), np.concatenate(nodes)
        order = np.argsort(sig)
        sig, place = sig[order], place[order]
        starts = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0)
        sizes = np.diff(np.append(starts, len(sig)))
        hot = sizes > SMALL
        first = np.zeros(len(sig), bool)
        first[starts[hot]] = True
        crowd = np.repeat(hot, sizes)
        keep = ~crowd | first
        yield packed(sig[keep], place[keep], nodes, first[keep], False, 0)
        if hot.any():
            yield packed(sig[crowd], place[crowd], nodes, np.zeros(int(crowd.sum()), bool), True, turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, seen, turn = np.uint64((1 << bits) - 1), set(), (TaskContext.get().partitionId() if TaskContext.get() else 0) * 7_919
        sigs, owners, nodes, held, n = [], [], [], 0, 0
        for batch in batches:
            for part in common.slices(batch):
                flat, sizes = shingle_sets(common.texts_of(part))
                keys = set_keys(flat, sizes)
                new = np.zeros(len(keys), bool)
                for i in np.flatnonzero(sizes > 0).tolist():
                    if (key := int(keys[i])) not in seen:
                        seen.add(key)
                        new[i] = True
                flat, sizes, keys = flat[np.repeat(new, sizes)], sizes[new], keys[new]
                sig, owner = signatures(flat, sizes, shipped.value)
                sigs.append(sig & mask)
                owners.append(owner + held)
                nodes.append(keys)
                held, n = held + len(keys), n + len(sig)
                if n >= CHUNK:
                    turn += 1
                    yield from chunk(sigs, owners, nodes, turn)
                    sigs, owners, nodes, held, n = [], [], [], 0, 0
        if n:
            yield from chunk(sigs, owners, nodes, turn + 1)

    return docs.select("text").mapInArrow(run, "bucket int, large boolean, n long, sigs binary, places binary, nodes binary")


def candidates(rows: DataFrame) -> DataFrame:
    """kind, a, b: kind 0 are candidate pairs a < b, kind 1 the members (signature, node) of groups of more than SMALL."""

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([np.zeros(len(a), np.int64), np.minimum(a, b), np.maximum(a, b)])

    def star(sig: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        """Members of groups and pairs of each with the first of its group; sorted by signature and node."""
        starts = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0)
        first = np.repeat(node[starts], np.diff(np.append(starts, len(sig))))
        rest = node != first
        return [np.stack([np.ones(len(sig), np.int64), sig, node]), pairs(first[rest], node[rest])]

    def run(table: pa.Table) -> pa.Table:
        parts = {False: ([], [], []), True: ([], [], [])}
        for large, n, sigs, places, nodes in zip(*(table.column(c).to_pylist() for c in ("large", "n", "sigs", "places", "nodes")), strict=True):
            place = unplanes(places).astype(np.int64)
            assert len(place) == n
            for x, y in zip(parts[large], (np.cumsum(unplanes(sigs)).view(np.int64), np.frombuffer(nodes, np.int64)[place >> 1], (place & 1).astype(bool)), strict=True):
                x.append(y)
        out = [np.zeros((3, 0), np.int64)]
        if parts[True][0]:
            sig, node, _ = map(np.concatenate, parts[True])
            order = np.lexsort((node, sig))
            out += star(sig[order], node[order])
        if parts[False][0]:
            sig, node, mark = map(np.concatenate, parts[False])
            order = np.argsort(sig)
            sig, node, mark = sig[order], node[order], mark[order]
            again = np.zeros(len(sig), bool)
            again[1:] = sig[1:] == sig[:-1]
            again[:-1] |= again[1:]
            again |= mark
            sig, node, mark = sig[again], node[again], mark[again]
            order = np.lexsort((~mark, node, sig))
            sig, node, mark = sig[order], node[order], mark[order]
            new = np.ones(len(sig), bool)  # the same set signed by several tasks; a marked one stays
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node, mark = sig[new], node[new], mark[new]
            starts = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0)
            sizes = np.diff(np.append(starts, len(sig)))
            large = (sizes > SMALL) | (np.add.reduceat(mark, starts) > 0 if len(starts) else np.zeros(0, bool))
            for size in np.unique(sizes[~large & (sizes > 1)]):
                at = starts[~large & (sizes == size)]
                i, j = np.triu_indices(size, 1)
                out.append(pairs(node[at[:, None] + i].ravel(), node[at[:, None] + j].ravel()))
            crowd = np.repeat(large, sizes)
            out += star(sig[crowd], node[crowd])
        kind, a, b = np.concatenate(out, axis=1)
        return pa.table({"kind": pa.array(kind.astype(np.int8)), "a": pa.array(a), "b": pa.array(b)})

    return rows.groupBy("bucket").applyInArrow(lambda t: run(t), "kind byte, a long, b long")


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches (node, n, sketch) do not rule out."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            bound = np.array([difference(x, y) for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True)], np.int64)
            yield batch.filter(pa.array((DEN + NUM) * bound <= (DEN - NUM) * total)).select(["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").where((DEN * F.least("n_a", "n_b") >= NUM * F.greatest("n_a", "n_b")))
    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (least node of its component) of all ends of the edges (a, b), by alternating large and small stars.
    Minima are pre-aggregated; no neighbourhood is collected."""
    now = common.materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.materialise(large, "large-star")
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(first, "u")
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(first.select("u", F.col("m").alias("v"))).distinct()
        now = common.materialise(small, "small-star")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if new == mark:
            break
        mark = new
    return now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _blocks(size: Column, most: int) -> Column:
    return F.ceil(size / most).cast("int")


def _met(rows: DataFrame, group: str, size: str, most: int) -> DataFrame:
    """rows with part, lo and hi: a group of more than `most` rows is dealt to parts by node, and each row to all pairs
    of parts that its own part is in, so that any two rows of a group meet."""
    parts = _blocks(F.col(size), most)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumn("lo", F.least("part", "_other")).withColumn("hi", F.greatest("part", "_other")).drop("_other")


def _open_edges(members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: edges that join what sketches do not rule out in the groups whose members have not all one label, as few as
    join it: less than one for each row of a block."""
    labelled = members.distinct().join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = labelled.groupBy("group").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("group", "size")
    dealt = _met(labelled.join(split, "group"), "group", "size", SKETCHED)
    rows = dealt.join(nodes.select("node", "n", "sketch"), "node").select(F.xxhash64("group", "lo", "hi").alias("unit"), "node", "label", "n", "sketch")

    def run(table: pa.Table) -> pa.Table:
        node, label, n = (table.column(c).to_numpy() for c in ("node", "label", "n"))
        root = np.unique(label, return_inverse=True)[1]
        raw = [np.frombuffer(x, np.uint8) for x in table.column("sketch").to_pylist()]
        cells = min(map(len, raw))  # sketches of one band differ by a factor of two or four; the longer are folded
        counts = np.stack([x.reshape(-1, cells).sum(0, dtype=np.int16) for x in raw])
        a, b = [], []
        asked = np.zeros(len(node), bool)
        # a row looks at all rows of other labels, in rounds; those that never do have one label in the end
        while len(some := np.flatnonzero(~asked & (root != np.bincount(root).argmax()))[:64]):
            asked[some] = True
            for i in some.tolist():
                other = np.flatnonzero((root != root[i]) & (DEN * np.minimum(n, n[i]) >= NUM * np.maximum(n, n[i])))
                bound = np.abs(counts[other] - counts[i]).sum(1, dtype=np.int64)
                near = other[(DEN + NUM) * bound <= (DEN - NUM) * (n[other] + n[i])]
                found, one = np.unique(root[near], return_index=True)
                for r, k in zip(found.tolist(), near[one].tolist(), strict=True):
                    a.append(node[i])
                    b.append(node[k])
                    root[root == r] = root[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("unit").applyInArrow(lambda t: run(t), "a long, b long")


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right)]
    found, inverse, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *left, *right]), return_inverse=True, return_counts=True)
    often = n > 1
    column = (np.cumsum(often) - 1)[inverse]
    use = often[inverse]
    rows = [np.repeat(np.arange(len(s)), s) for s in sizes]
    cut = int(sizes[0].sum())
    total = np.zeros((len(left), len(right)), np.float32)
    step = 4_096
    x = [(rows[0][use[:cut]], column[:cut][use[:cut]]), (rows[1][use[cut:]], column[cut:][use[cut:]])]
    order = [np.argsort(c, kind="stable") for _, c in x]
    x = [(r[o], c[o]) for (r, c), o in zip(x, order, strict=True)]
    for at in range(0, int(often.sum()), step):
        dense = []
        for (r, c), s in zip(x, sizes, strict=True):
            i, j = np.searchsorted(c, (at, at + step))
            m = np.zeros((len(s), step), np.float32)
            m[r[i:j], c[i:j] - at] = 1
            dense.append(m)
        total += dense[0] @ dense[1].T
    return total.astype(np.int64)


def _compared(docs: DataFrame, clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label, links of the sets in clusters (node, label), a row for each block that a set is in: the least node
    that it is joined with there, and the sets there that are similar to it. All sets of a cluster are compared exactly.
    Only the texts of sets in clusters are read into Python."""
    sizes = clusters.groupBy("label").agg(F.count("*").alias("size"))
    total = clusters.count()
    dealt = _met(clusters.join(sizes, "label"), "label", "size", COMPARED)
    alone = F.pmod(F.xxhash64("label"), F.lit(max(1, total // UNIT)))
    unit = F.when(F.col("size") <= COMPARED, alone).otherwise(F.xxhash64("label", "lo", "hi"))
    members = common.materialise(dealt.select(unit.alias("unit"), "label", "node", "part", "lo", "hi").join(nodes.select("node", "rep"), "node"), "members")
    few = members.limit(common.MOST_BROADCAST + 1).count() <= common.MOST_BROADCAST
    texts = _narrow(docs).join(F.broadcast(members) if few else members, F.col("doc_id").eqNullSafe(F.col("rep"))).select("unit", "label", "node", "part", "lo", "hi", "text")

    def run(table: pa.Table) -> pa.Table:
        clusters: dict[int, dict[int, tuple[bool, np.ndarray]]] = {}
        across: dict[int, bool] = {}
        for batch in table.to_batches():
            for part in common.slices(batch):
                flat, n = shingle_sets(common.texts_of(part))
                keys, ends = set_keys(flat, n).tolist(), np.cumsum(n).tolist()
                for label, node, own, lo, hi, key, end, size in zip(*(part.column(c).to_pylist() for c in ("label", "node", "part", "lo", "hi")), keys, ends, n.tolist(), strict=True):
                    if size and key == node:  # an id may have other texts
                        clusters.setdefault(label, {})[node] = (own != lo, flat[end - size : end].copy())
                        across[label] = lo != hi
        out = [np.zeros((3, 0), np.int64)]
        for label, found in clusters.items():
            node = np.array(sorted(found), np.int64)
            sets = [found[k][1] for k in node.tolist()]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            if across[label]:  # pairs within a part are counted where it meets itself
                side = np.array([found[k][0] for k in node.tolist()])
                near = np.zeros((len(sets), len(sets)), bool)
                i, j = np.flatnonzero(~side), np.flatnonzero(side)
                both = shared([sets[k] for k in i], [sets[k] for k in j])
                near[np.ix_(i, j)] = DEN * both >= NUM * (n[i][:, None] + n[j][None, :] - both)
                near |= near.T
            else:
                both = shared(sets, sets)
                near = DEN * both >= NUM * (n[:, None] + n[None, :] - both)
                np.fill_diagonal(near, False)
            root = np.arange(len(node))
            while True:  # each takes the least label among its neighbours and itself
                low = np.minimum(root, np.where(near, root[None, :], len(node)).min(1, initial=len(node)))
                low = low[low]
                if (low == root).all():
                    break
                root = low
            out.append(np.stack([node, node[root], near.sum(1)]))
        node, least, links = np.concatenate(out, axis=1)
        return pa.table({"node": pa.array(node), "label": pa.array(least), "links": pa.array(links)})

    return texts.groupBy("unit").applyInArrow(lambda t: run(t), "node long, label long, links long")


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """node_rows, the distinct sets, and node, label, links of the sets in clusters, as written tables."""
    written = common.materialise(node_rows(docs), "nodes")
    rows = written.where("slice is null").drop("slice", "counts")
    nodes = common.materialise(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "unique-sets")
    expected = int(PER_SHINGLE * nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0])
    rarity = rarity_table(written.where("slice is not null").select("slice", "counts"))
    found = common.materialise(candidates(signature_rows(docs, rarity, expected)), "candidates")
    edges = common.materialise(_possible(found.where("kind = 0").select("a", "b").distinct(), nodes), "possible-pairs")
    clusters = common.materialise(components(edges), "clusters")
    more = common.materialise(_open_edges(found.where("kind = 1").select(F.col("a").alias("group"), F.col("b").alias("node")), clusters, nodes), "open-edges")
    if not more.isEmpty():
        clusters = common.materialise(components(clusters.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)), "clusters")
    compared = common.materialise(_compared(docs, clusters, nodes), "compared")
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(compared.select(F.col("node").alias("a"), F.col("label").alias("b")))
    return rows, nodes, common.materialise(links.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "links"), "labels")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, component_id, n_links of every row of docs.

    n_links: the other sets that are similar to this row's set; copies are the same set. Empty texts, null or without a
    word, have an empty set, are linked with nothing and are their own class. A null id takes part but is never the
    name of a class with other ids. Repeated rows give a row each; an empty table gives none.
    """
    with common.arrow_rows(docs.sparkSession, TEXTS):
        rows, nodes, labels = _linked(docs)
    named = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    ids = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(ids, "label").select("node", "component_id", "n_links")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.drop("sketch").join(named, "node", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that name their class (the lowest doc_id), columns unchanged. Of rows equal in id and text one
    stays; empty texts are in no class and stay."""
    found = common.materialise(classes(docs).select("doc_id", "key", "component_id"), "classes")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id_"), F.col("key").alias("_hash_")).distinct()
    repeated = not found.groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    return common.keyed_rows(docs, kept, repeated).select(*[docs[c] for c in docs.columns])
