"""Mixing sources to target weights by balanced sampling (the cube method).

A source's target is its weight's share of all words, capped at a multiple of its own words. A document is taken
floor(target / words) times and once more with the fractional probability. The cube method rounds these
probabilities: in the flight phase fractional documents move along the null-space of the two balancing constraints
(documents, words) until one is settled: the longer half one by one against all the shorter, so that no long document
is left for the end, then three at a time. Salted groups of a source fly first, in parallel; the
two or three documents that each leaves fly again by source; the last two are rounded to the nearest total.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents of a salted group, about.
GROUP = 2_000
#: No source gives more than this many times its own words.
MOST = 3


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities p until at most two are fractional, keeping sum(p) and sum(p * x) up to rounding errors."""
    p = p.astype(float).tolist()
    x = x.astype(float).tolist()
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    eps = 1e-9
    hand: list[int] = []
    for i, v in enumerate(p):
        if v <= eps or v >= 1 - eps:
            p[i] = round(v)
            continue
        hand.append(i)
        if len(hand) < 3:
            continue
        a, b, c = hand
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / w if w > 0 else p[k] / -w for k, w in zip(hand, u, strict=True) if w)
        down = min(p[k] / w if w > 0 else (1 - p[k]) / -w for k, w in zip(hand, u, strict=True) if w)
        step = up if next(draws) * (up + down) < down else -down
        for k, w in zip(hand, u, strict=True):
            p[k] += step * w
            if p[k] <= eps or p[k] >= 1 - eps:
                p[k] = float(round(p[k]))
        hand = [k for k in hand if 0.0 < p[k] < 1.0]
    return np.array(p)


def settle_longest(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settles the longer half: each moves along a null-space vector that spreads what it gains over all shorter ones."""
    p, x, eps = p.astype(float), x.astype(float), 1e-9
    order = np.argsort(-x, kind="stable")
    order = order[(p[order] > eps) & (p[order] < 1 - eps)]
    for j, a in enumerate(order[: len(order) // 2]):
        rest = order[j + 1 :]
        for _ in range(4):
            w = p[rest] * (1 - p[rest])
            w[(p[rest] <= eps) | (p[rest] >= 1 - eps)] = 0
            s0, s1, s2 = w.sum(), (w * x[rest]).sum(), (w * x[rest] ** 2).sum()
            det = s0 * s2 - s1 * s1
            if not eps < p[a] < 1 - eps or s0 <= eps or det <= 1e-9 * s0 * s2:
                break
            u = w * ((-s2 + x[a] * s1) + (s1 - x[a] * s0) * x[rest]) / det
            with np.errstate(divide="ignore", invalid="ignore"):
                up = min(1 - p[a], np.nanmin(np.where(u > 0, (1 - p[rest]) / u, np.where(u < 0, p[rest] / -u, np.inf))))
                down = min(p[a], np.nanmin(np.where(u > 0, p[rest] / u, np.where(u < 0, (1 - p[rest]) / -u, np.inf))))
            step = up if rng.random() * (up + down) < down else -down
            p[a] += step
            p[rest] = np.clip(p[rest] + step * u, 0, 1)
    return np.where(p <= eps, 0.0, np.where(p >= 1 - eps, 1.0, p))


def land(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rounds the few fractional entries to the combination whose words come nearest, then whose documents do."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    want, best = ((p[open_] * x[open_]).sum(), p[open_].sum()), None
    for bits in range(1 << len(open_)):
        s = np.array([bits >> j & 1 for j in range(len(open_))], float)
        off = (abs((s * x[open_]).sum() - want[0]), abs(s.sum() - want[1]))
        if best is None or off < best[0]:
            best = (off, s)
    p = p.copy()
    p[open_] = best[1]
    return p


def _ranks(sources: DataFrame) -> DataFrame:
    """sources with the row number `rank` in code-point order, null last, without a global sort in one task."""
    parts = common.materialise(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("part").count()
    base = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("rank", within).join(base, "part").select("source", "source_size", "n_docs", (F.col("rank") - 1 + F.col("base")).alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, n_docs -> with target. Weights repeat over the sources in code-point order, null last."""
    ranked = _ranks(sources)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = common.materialise(ranked.withColumn("weight", weight), "ranked-sources")
    top = most * F.col("source_size").cast("double")
    total, level = float(ranked.agg(F.sum("source_size")).head()[0] or 0), 0.0
    while True:  # the level of water rises each time, over finitely many caps
        above = F.col("weight") * level > top
        full, rest = ranked.agg(F.sum(F.when(above, top).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).head()
        new = (total - full) / rest if rest else level
        if not rest or new <= level * (1 + 1e-15):
            break
        level = new
    return ranked.select("source", "source_size", "n_docs", F.least(F.col("weight") * level, top).alias("target"))


_SCHEMA = "doc_id long, key long, size long, source string, source_size long, target double, base int, p double, salts int, salt int"


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """doc_id, key (hash of the text and the source), source, size, source_size, target, copies, taken of every row of docs.

    A null text has size 0; a null source is a source of its own, the last. Repeated rows are units of their own.
    Documents of size 0 may have copies but no taken words. An empty table gives no rows. The draws depend on the
    rows alone: reruns agree.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.col("source").cast("string")).alias("key"), F.col("source").cast("string").alias("source"), common.words_in(F.col("text")).alias("size"))
    rows = common.materialise(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    aims = common.materialise(targets(sources, weights, most), "targets").withColumnRenamed("source", "_source_")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    units = (
        rows.join(aims, F.col("source").eqNullSafe(F.col("_source_")))
        .withColumn("base", F.floor(ratio + 1e-12).cast("int"))
        .withColumn("p", F.greatest(ratio - F.col("base"), F.lit(0.0)))
        .withColumn("salts", F.ceil(F.col("n_docs") / GROUP).cast("int"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.col("salts")).cast("int"))
        .select("doc_id", "key", "size", "source", "source_size", "target", "base", "p", "salts", "salt")
    )

    def seeded(pdf: pd.DataFrame, what: str) -> tuple[pd.DataFrame, np.random.Generator]:
        first = pdf.iloc[0]
        rng = np.random.default_rng(zlib.crc32(f"{what}|{first['source']}|{first['salt']}".encode()))
        # the longest first: those that stay fractional to the end are then short
        return pdf.sort_values(["size", "doc_id", "key"], ascending=False, kind="stable").reset_index(drop=True), rng

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rng = seeded(pdf, "fly")
        x = pdf["size"].to_numpy(float)
        return pdf.assign(p=flight(settle_longest(pdf["p"].to_numpy(), x, rng), x, rng))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rng = seeded(pdf, "land")
        x = pdf["size"].to_numpy(float)
        return pdf.assign(p=land(flight(settle_longest(pdf["p"].to_numpy(), x, rng), x, rng), x))

    flown = common.materialise(units.groupBy("source", "salt").applyInPandas(fly, _SCHEMA), "flown")
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    landed = flown.where(open_).withColumn("salt", F.lit(0)).groupBy("source").applyInPandas(settle, _SCHEMA)
    copies = (F.col("base") + F.round("p").cast("int")).cast("long")
    done = flown.where(~open_).unionByName(landed)
    return done.select("doc_id", "key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns unchanged. Of rows equal in id, text and source one
    comes as often as the mix takes them together."""
    copies = mix(docs, weights, most).groupBy("doc_id", "key").agg(F.sum("copies").alias("_copies_"), F.count("*").alias("_rows_"))
    copies = common.materialise(copies.select(F.col("doc_id").alias("_id_"), F.col("key").alias("_hash_"), "_copies_", "_rows_"), "copies")
    repeated = not copies.where("_rows_ > 1").isEmpty()
    chosen = common.keyed_rows(docs, copies.where("_copies_ > 0").drop("_rows_"), repeated, ("text", "source")).select(*[docs[c] for c in docs.columns], "_copies_")
    return chosen.withColumn("_copy_", F.explode(F.sequence(F.lit(1), F.col("_copies_")))).select(*docs.columns)
