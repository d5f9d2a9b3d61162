"""Centroid clustering of integer vectors by Exponion search.

Each vector keeps its centroid, an upper bound of its distance to it and a lower bound of its distance to any other.
When centroids have moved, the bounds move with them; a vector whose upper bound is below the lower one, or below half
the distance from its centroid to the nearest other, stays without a look. For the rest only centroids in a ball
around the current one are scanned, of radius 2 u + s (u: the distance to the centroid, s: from the centroid to the
nearest other one), found in sorted lists of distances between centroids; the nearest and second nearest centroid are
always inside. The radius is inclusive and bounds are rounded outwards, so ties are seen; distances themselves are exact
integers.

A round is one pass without a shuffle: it reads the last round's table, writes the next, and each task adds one row a
centroid with sums and counts. What reaches the driver is k x components numbers, whatever the number of vectors.

Defined results: null, short, long vectors and those with a component that is null, not finite or of a size of 2^43 or
more (squares of such no long can hold) are left out; a null vec_id hashes as the empty text; repeated rows count each
time; of equal hashes the smaller vector comes first; fewer vectors than centroids give fewer centroids; an empty table
gives no rows; other columns are ignored. Distances and sums beyond a long are given as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, shared_path

#: Sums over the rows of a batch of components below this (after scaling) fit 64 bits.
EXACT = 1 << 27
#: Bounds are floating-point numbers: rounded outwards by this share.
SLACK = 1e-9
#: Pairs of vector and centroid that are compared at a time.
MOST_PAIRS = 1 << 13
LONGEST = (1 << 63) - 1
_STATE = "vec_id long, v array<float>, cluster int, u double, l double, distance decimal(38,0), sums array<decimal(38,0)>, n long"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) as 64-bit integers."""
    return np.floor(1024.0 * vectors.astype(np.float64)).astype(np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v and c: 64-bit integers, or Python's where those could overflow."""
    most = int(max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * v.shape[1] > LONGEST:
        d = v.astype(object) - c.astype(object)
        return (d * d).sum(axis=1)
    d = v - c
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Centroids of a round with their sorted mutual distances and how far they have moved since the last."""

    def __init__(self, now: list[list[int]], before: list[list[int]] | None = None):
        c = self.c = np.array(now, np.int64).reshape(len(now), -1)
        k = self.k = len(c)
        root = lambda d: np.sqrt(d.astype(np.float64))
        mutual = np.stack([root(squared(c, np.broadcast_to(c[j], c.shape))) for j in range(k)]) if k else np.zeros((0, 0))
        self.order = np.argsort(mutual, axis=1, kind="stable")
        self.near = np.take_along_axis(mutual, self.order, axis=1)
        others = mutual + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.gap = others.min(axis=1, initial=np.inf)
        moved = root(squared(c, np.array(before, np.int64))) * (1 + SLACK) if before is not None else np.zeros(k)
        self.moved = moved
        top = np.sort(moved)[::-1]
        self.others_moved = np.where(np.arange(k) == moved.argmax(), top[1] if k > 1 else 0.0, top[0]) if k else moved

    def assign(self, v: np.ndarray, cluster: np.ndarray, u: np.ndarray, low: np.ndarray) -> int:
        """Updates cluster, u and low in place; cluster -1 means none yet. Returns the number of distances computed."""
        seen = cluster >= 0
        u[seen] = (u[seen] + self.moved[cluster[seen]]) * (1 + SLACK)
        low[seen] -= self.others_moved[cluster[seen]] + SLACK * np.abs(low[seen])
        half = np.where(seen, self.gap[cluster] / 2 * (1 - SLACK), 0)
        open_ = np.flatnonzero(~seen | (u >= np.maximum(low, half)))
        old = open_[seen[open_]]
        done = 0
        if len(old):
            u[old] = np.sqrt(squared(v[old], self.c[cluster[old]]).astype(np.float64)) * (1 + SLACK)
            done += len(old)
            open_ = open_[~seen[open_] | (u[open_] >= np.maximum(low[open_], half[open_]))]
        first = ~seen[open_]
        own = np.where(first, 0, cluster[open_])
        radius = np.where(first, np.inf, (2 * u[open_] + self.gap[own]) * (1 + SLACK))
        sizes = np.full(len(open_), self.k)
        for j in range(self.k):
            mine = own == j
            sizes[mine] = np.searchsorted(self.near[j], radius[mine], side="right")
        at = 0
        ends = np.cumsum(sizes)
        while at < len(open_):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PAIRS, side="right")))
            done += self._nearest(v, open_[at:to], own[at:to], sizes[at:to], cluster, u, low)
            at = to
        return done

    def _nearest(self, v, rows, own, sizes, cluster, u, low) -> int:  # noqa: ANN001
        """The nearest and second nearest of the first `sizes` centroids in the list of `own`."""
        which = np.repeat(np.arange(len(rows)), sizes)
        candidate = self.order[own[which], ranges(np.zeros(len(rows), np.int64), sizes)]
        d = squared(v[rows[which]], self.c[candidate])
        order = np.lexsort((candidate, d, which)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda i: (which[i], d[i], candidate[i])))
        starts = np.cumsum(sizes) - sizes
        best, second = order[starts], order[np.minimum(starts + 1, len(order) - 1)]
        cluster[rows] = candidate[best]
        u[rows] = np.sqrt(d[best].astype(np.float64)) * (1 + SLACK)
        low[rows] = np.where(sizes > 1, np.sqrt(d[second].astype(np.float64)) * (1 - SLACK), np.inf)
        return len(d)


def _kept(table: DataFrame, width: int) -> DataFrame:
    x = F.col("embedding")
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float(1 << 43)))
    return table.where((F.size(x) == width) & F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<float>" if "float" in table.schema["embedding"].dataType.simpleString() else "array<double>").alias("v"))


def _pass(state: DataFrame, centroids: Centroids, schema: str, last: bool) -> DataFrame:
    """One assignment of all vectors, with a row of sums for each centroid and task."""
    width, double = centroids.c.shape[1], "array<double>" in schema
    arrow = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64() if double else pa.float32())), ("cluster", pa.int32()), ("u", pa.float64()), ("l", pa.float64()), ("distance", pa.decimal128(38, 0)), ("sums", pa.list_(pa.decimal128(38, 0))), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * width for _ in range(centroids.k)], np.zeros(centroids.k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = scaled(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width))
            cluster, u, low = (np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("cluster", "u", "l"))
            centroids.assign(v, cluster, u, low)
            for j in np.unique(cluster).tolist():
                mine = v[cluster == j]
                counts[j] += len(mine)
                added = mine.sum(axis=0) if np.abs(mine).max() < EXACT else mine.astype(object).sum(axis=0)
                sums[j] = [a + int(b) for a, b in zip(sums[j], added, strict=True)]
            distance = pa.array(squared(v, centroids.c[cluster]).tolist() if last else [None] * len(v), pa.decimal128(38, 0))
            none = pa.nulls(len(v), pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(u), pa.array(low), distance, none, pa.nulls(len(v), pa.int64())], schema=arrow)
        rows = [{"cluster": j, "sums": sums[j], "n": int(counts[j])} for j in np.flatnonzero(counts).tolist()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return state.select("vec_id", "v", "cluster", "u", "l").mapInArrow(run, schema)


class _Rounds:
    """The table of the current round in the shared folder; the one before goes when the next is written."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.base, self.n = spark, schema, shared_path(spark, "exponion"), 0
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.path = lambda n: hadoop(f"{self.base}/round={n}")
        self.fs = hadoop(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(hadoop(self.base))

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.base}/round={self.n}")
        if self.n > 1:
            self.fs.delete(self.path(self.n - 1), True)
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/round={self.n}")


def cluster(table: DataFrame, k: int = 8, width: int = 64, rounds: int = 10, salt: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors of table (vec_id, embedding).

    Centroids start as the k vectors with the smallest sha256 of salt and id. Each round assigns all vectors and takes the
    floored means of what a centroid has; after the last round vectors are assigned once more.
    """
    spark = table.sparkSession
    points = _kept(table, width)
    schema = _STATE.replace("array<float>", points.schema["v"].dataType.simpleString(), 1)
    hashed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = points.select(hashed.alias("_hash_"), "v").orderBy("_hash_", "v").limit(k).collect()  # k rows
    now, before, store = [scaled(np.array(r["v"])).tolist() for r in first], None, _Rounds(spark, schema)
    state = points.select("vec_id", "v", F.lit(-1).cast("int").alias("cluster"), F.lit(0.0).alias("u"), F.lit(0.0).alias("l"))
    if not now:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for step in range(rounds + 1):
        state = store.put(_pass(state.where("n is null") if step else state, Centroids(now, before), schema, last=step == rounds))
        if step < rounds:
            added = state.where("n is not null").select("cluster", "n", F.posexplode("sums").alias("i", "x"))
            means = added.groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # k x width rows
            before, now = now, [list(c) for c in now]
            for r in means:
                now[r["cluster"]][r["i"]] = int(r["x"]) // r["n"]
    return _digest(state.where("n is null"), now)


def _digest(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    long_ = lambda x: F.least(x, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    inertia = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    rows = [(j, min(d, LONGEST), min(sum(inertia.values()), LONGEST), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, d in inertia.items()]
    about = state.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", long_(F.col("distance")).alias("distance")).join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
