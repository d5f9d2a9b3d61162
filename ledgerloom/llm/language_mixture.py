"""Language identification as mixture inference.

Each language has a multinomial over hashed character n-grams. A document is a mixture of languages; expectation
maximisation over its words estimates the proportions, for the best one, two, ... languages in turn, and the set with
the highest penalised likelihood wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows of the n-gram table, and entries of the model at most: with more languages it has fewer rows. This bounds what
#: the driver collects (a row a language) and broadcasts.
BUCKETS, MOST_ENTRIES = 1 << 16, 1 << 25
#: Rounds of EM, smoothing, and how far one word may speak against a language.
ROUNDS, ALPHA, FLOOR = 12, 0.5, -14.0
#: Added to 0.5 log(words) for each further language of a set.
PENALTY = 6.0
UNKNOWN = "und"

_WORDS = re.compile(r"[^\W\d_]+")


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for word in words:
        c = [1, *map(ord, word), 2]
        out.append([(a * 0x9E3779B1 + b * 0x85EBCA6B + d * 0xC2B2AE35 >> 7) % BUCKETS for a, b, d in zip(c, c[1:], c[2:], strict=False)])
    return common.flattened(out)


_cache = common.FlatCache(_grams)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; none if the text has no letter."""
    return _WORDS.findall(text.lower()) if any(c.isalpha() for c in text) else []


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # bucket, language

    def infer(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its share, and the shares of all languages, of each text."""
        shares = np.zeros((len(texts), len(self.languages)), np.float32)
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), shares
        lists = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        has = np.flatnonzero(counts)
        if len(has):
            shares[has] = self._mixtures(_cache.rows([w for x in lists for w in x]), counts[has])
        best = shares.argmax(1)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, counts, strict=True)]
        return names, shares.max(1).astype(float), shares

    def _mixtures(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        unique, inverse = np.unique(rows, return_inverse=True)
        sizes = _cache.size[unique]
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ll = np.add.reduceat(self.log_p[_cache.ids(unique) & (len(self.log_p) - 1)], at, axis=0)
        top = ll.max(1, keepdims=True)
        p = np.exp(np.maximum(ll - top, FLOOR)).astype(np.float32)[inverse]
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        single = np.add.reduceat(np.log(np.maximum(p, 1e-30)), starts, axis=0).astype(np.float64)
        best, value = single.argmax(1), single.max(1)
        chosen = np.zeros(single.shape, np.float32)
        # one language: its posterior probability among all, each taken alone
        chosen[np.arange(len(best)), best] = 1 / np.exp(single - value[:, None]).sum(1)
        languages = p.shape[1]
        if languages == 1:
            return chosen
        everything, ll = _em(p, counts, np.ones((len(counts), languages), np.float32))
        order = np.argsort(-everything, axis=1, kind="stable")
        # no mixture of any languages is likelier than this: sets go on until they could not win however well they fit
        most = ll + _slack(p, counts, everything)
        penalty = 0.5 * np.log(counts) + PENALTY
        for m in range(2, languages + 1):
            open_ = np.flatnonzero(most - (m - 1) * penalty > value)
            if not len(open_):
                break
            words = np.repeat(np.isin(np.arange(len(counts)), open_), counts)
            allowed = np.zeros((len(open_), languages), np.float32)
            np.put_along_axis(allowed, order[open_, :m], 1, axis=1)
            share, ll = _em(p[words], counts[open_], allowed)
            gain = ll - (m - 1) * penalty[open_]
            better = gain > value[open_]
            chosen[open_[better]], value[open_[better]] = share[better], gain[better]
        return chosen


def _em(p: np.ndarray, counts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages for each document and the log-likelihoods. p: likelihoods by word and language."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    n, used = counts.astype(np.float32), np.flatnonzero(allowed.any(0))
    columns = [np.ascontiguousarray(p[:, k]) for k in used]  # one language after the other: whole vectors at a time
    share = [np.ascontiguousarray(x) for x in (allowed / allowed.sum(1, keepdims=True)).T[used]]

    def mixed() -> np.ndarray:
        total = np.zeros(len(p), np.float32)
        for column, own in zip(columns, share, strict=True):
            total += column * np.repeat(own, counts)
        return np.maximum(total, 1e-30)

    for _ in range(ROUNDS):
        weight = 1 / mixed()
        share = [own * np.add.reduceat(column * weight, starts) / n for column, own in zip(columns, share, strict=True)]
    out = np.zeros(allowed.shape, np.float32)
    out[:, used] = np.stack(share, axis=1)
    return out, np.add.reduceat(np.log(mixed(), dtype=np.float64), starts)


def _slack(p: np.ndarray, counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What the log-likelihoods may still gain at most over these shares: words times the log of the largest mean ratio
    of a language's likelihood to the mixture's (the log-likelihood is concave in the shares)."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    mixed = np.maximum(np.einsum("ij,ij->i", p, np.repeat(share, counts, axis=0)), 1e-30)[:, None]
    ratio = np.add.reduceat(p / mixed, starts, axis=0, dtype=np.float64) / counts[:, None]
    return counts * np.log(np.maximum(ratio.max(1), 1))


def fit(labelled: DataFrame) -> Model:
    """Learns from all rows (text, lang); null texts or languages are ignored. Each task sums n-gram counts by language
    before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in common.slices(batch):
                by: dict[str, Counter] = {}
                for text, lang in zip(common.texts_of(part), part.column("lang").to_pylist(), strict=True):
                    by.setdefault(lang, Counter()).update(words_of(text))
                for lang, seen in by.items():
                    rows = _cache.rows(list(seen))
                    n = np.repeat(np.fromiter(seen.values(), np.int64, len(seen)), _cache.size[rows])
                    sums[lang] = sums.get(lang, 0) + np.bincount(_cache.ids(rows), n, BUCKETS).astype(np.int64)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    summed = common.materialise(known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "n-grams")
    languages = summed.select("lang").distinct().count()
    rows = BUCKETS
    while rows > 2 and rows * languages > MOST_ENTRIES:
        rows //= 2

    def table(own: pa.Table) -> pa.Table:
        n = np.bincount(own.column("bucket").to_numpy() & (rows - 1), own.column("n").to_numpy(), rows) + ALPHA
        return pa.table({"lang": own.column("lang")[:1], "log_p": pa.array([np.log(n / n.sum()).astype("<f4").tobytes()], pa.binary())})

    found = sorted((r["lang"], bytes(r["log_p"])) for r in summed.groupBy("lang").applyInArrow(table, "lang string, log_p binary").collect())  # a row a language, BUCKETS rows in a group
    return Model([lang for lang, _ in found], np.stack([np.frombuffer(x, "<f4") for _, x in found], axis=1) if found else np.zeros((1, 0), np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of docs as a struct), lang_pred and score (its share; its posterior if it is the only one),
    languages (the set, in code-point order) and shares (theirs, likewise). Only the text is looked at.

    A null text or one without a letter gives `und`, 0 and an empty set. Ties go to the first language in code-point order.
    Repeated rows give a row each; an empty table gives none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "row.text"):
                names, score, found = shipped.value.infer(common.texts_of(part, "row.text"))
                doc, lang = np.nonzero(found)
                offsets = pa.array(np.searchsorted(doc, np.arange(len(found) + 1)).astype(np.int32))
                languages = pa.ListArray.from_arrays(offsets, pa.array([shipped.value.languages[k] for k in lang], pa.string()))
                shares = pa.ListArray.from_arrays(offsets, pa.array(found[doc, lang].astype(float)))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names, pa.string()), pa.array(score, pa.float64()), languages, shares], ["row", "lang_pred", "score", "languages", "shares"])

    more = "lang_pred string, score double, languages array<string>, shares array<double>"
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *T.StructType.fromDDL(more).fields]))


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return common.crc_of_id(doc_id) % parts == part


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs, learnt from those not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, model).select("row.doc_id", "row.held_out", "lang_pred", "score")
