"""Quality classifier by co-training.

Two views of a document each have a logistic classifier: its content (words, their shapes and shares of characters) and
its page (source, language, length and the layout of its lines; no word is looked at).
Over some rounds each view judges all unlabelled documents and hands its most confident judgements to the other as
labels. The two are calibrated on labelled documents kept back and combined; the combination scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Documented bounds of what the driver fits on: labelled documents, judgements that a view hands over for each class
#: and round (the most confident of all documents), hashed features, chosen features.
MOST_LABELLED, MOST_GIVEN, BUCKETS, CHOSEN = 8_000, 2_000, 1 << 18, 1_024
ROUNDS, SHARE, SURE = 3, 0.05, 0.9
#: Beginnings of words that are features, in characters.
PREFIXES = (4, 6)
SEEN_IN = 4
_SURE_ODDS = float(np.log(SURE / (1 - SURE)))

_TABLE = {**{ord(c): "a" for c in common.LOWER}, **{ord(c): "A" for c in common.UPPER}, **{ord(c): "0" for c in "0123456789"}}


def _h(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) % BUCKETS


_STEPS = {k: [_h("c", f"{k}>{i}") for i in range(40)] for k in ("upper", "digit", "mark", "bar", "distinct", "word")}


#: Features of shapes and of beginnings of words that this worker met, MOST_MET of each at most.
_shapes: dict[str, list[int]] = {}
_begins: dict[str, int] = {}
MOST_MET = 100_000


def _shape_features(shape: str) -> list[int]:
    short = shape[:1] + "".join(b for a, b in zip(shape, shape[1:], strict=False) if a != b)
    return [_h("t", shape[-3:]), _h("s", short[:8])]


def _word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for w in words:
        shape, bare = w.translate(_TABLE), w.lower().strip(".,;:!?%&*#$")
        if (own := _shapes.get(shape)) is None:
            own = _shape_features(shape)
            if len(_shapes) < MOST_MET:
                _shapes[shape] = own
        features = [_h("w", bare), *own]
        for k in PREFIXES:
            if (begin := _begins.get(bare[:k])) is None:
                begin = _h("p", bare[:k])
                if len(_begins) < MOST_MET:
                    _begins[bare[:k]] = begin
            features.append(begin)
        out.append(features)
    return common.flattened(out)


_cache = common.FlatCache(_word_features)


def _shares(text: str, words: list[str]) -> list[int]:
    """Features of a text's characters and words as a whole: every step of twentieths that a share reaches."""
    size = max(len(text), 1)
    letters = np.bincount(np.frombuffer(text.encode("ascii", "ignore"), np.uint8), minlength=128)
    marks = letters[33:48].sum() + letters[58:65].sum() + letters[91:97].sum() + letters[123:127].sum()
    shares = {
        "upper": letters[65:91].sum() / size, "digit": letters[48:58].sum() / size, "mark": marks / size, "bar": letters[124] / size,
        "distinct": len(set(words)) / max(len(words), 1), "word": size / max(len(words), 1) / 20,
    }
    return [x for k, v in shares.items() for x in _STEPS[k][: min(int(20 * v), 40)]]


def content_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs of the content view, each once."""
    lists = [t.split() for t in texts]
    whole = [_shares(t, x) for t, x in zip(texts, lists, strict=True)]
    rows = _cache.rows([w for x in lists for w in x])
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
    flat, n = common.flattened(whole)
    seen = np.sort(np.concatenate([np.repeat(doc, _cache.size[rows]) * BUCKETS + _cache.ids(rows), np.repeat(np.arange(len(texts)), n) * BUCKETS + flat]))
    seen = seen[np.diff(seen, prepend=-1) != 0]
    return seen // BUCKETS, seen % BUCKETS


def page_features(texts: list[str], sources: list[str | None], languages: list[str | None], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs of the page view: metadata, and the layout of lines, gaps and table cells in coarse steps."""
    doc, feature = [], []
    for i, (text, source, lang, n) in enumerate(zip(texts, sources, languages, n_chars, strict=True)):
        step = lambda x: int(2 * np.log2(x + 1))
        rows = text.split("\n")
        lines, blank, size = len(rows), text.count("\n\n"), len(text)
        own = [f"source={source}", f"lang={lang}", f"chars={int(np.log2((n or 0) + 1))}", f"lines={step(lines)}", f"width={step(size / lines)}", f"blank={int(10 * blank / lines)}", f"gaps={step(text.count('  '))}", f"tabs={step(text.count(chr(9)))}", f"cells={step(text.count('|') / lines)}", f"again={int(10 * (1 - len(set(rows)) / lines))}"]
        doc += [i] * len(own)
        feature += [_h("m", x) for x in own]
    return np.array(doc, np.int64), np.array(feature, np.int64)


def dense(lists: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """Rows of binary features, narrowed to the chosen columns; the last column is the constant."""
    at = np.full(BUCKETS, -1, np.int32)
    at[chosen] = np.arange(len(chosen))
    out = np.zeros((len(lists), len(chosen) + 1), np.uint8)
    out[:, -1] = 1
    for i, x in enumerate(lists):
        found = at[x]
        out[i, found[found >= 0]] = 1
    return out


def choose(lists: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The features that tell the classes apart best, by mutual information of presence; seen in SEEN_IN documents at least."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    in1, in0 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x, label in zip(lists, y, strict=True):
        (in1 if label else in0)[x] += 1
    p1, p0 = (in1 + 0.5) / (n1 + 1), (in0 + 0.5) / (n0 + 1)
    prior = n1 / (n1 + n0)
    mean = prior * p1 + (1 - prior) * p0
    gain = prior * (p1 * np.log(p1 / mean) + (1 - p1) * np.log((1 - p1) / (1 - mean))) + (1 - prior) * (p0 * np.log(p0 / mean) + (1 - p0) * np.log((1 - p0) / (1 - mean)))
    gain[(in1 + in0) < SEEN_IN] = 0
    best = np.argsort(-gain, kind="stable")[:CHOSEN]
    return np.sort(best[gain[best] > 0])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 250, ridge: float = 1e-3) -> np.ndarray:
    """Weights for binary features by accelerated gradient steps; the last column is the constant and is not shrunk."""
    x = x.astype(np.float32)
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    total = max(weight.sum(), 1e-9)
    step = 4 / max(float(x.sum(1).mean()), 1)
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 0
    for k in range(rounds):
        ahead = w + k / (k + 3) * v
        p = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(x.dtype), -30, 30)))
        new = ahead - step * ((weight * (p - y) / total).astype(x.dtype) @ x + shrink * ahead)
        w, v = new, new - w
    return w


def calibrated(odds: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of the two views' log-odds and a constant, by Newton's method. A view that would count against itself is
    left out and the rest fitted again."""
    use, out = [0, 1, 2], np.zeros(3)
    x = np.column_stack([odds, np.ones(len(odds))])
    while True:
        own, w = x[:, use], np.zeros(len(use))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            h = (own * (p * (1 - p))[:, None]).T @ own + 0.05 * np.eye(len(use))
            step = np.linalg.solve(h, own.T @ (y - p) - 0.05 * w)
            w += np.clip(step, -2, 2)
        wrong = [k for k, v in zip(use, w, strict=True) if k < 2 and v < 0]
        if not wrong:
            out[use] = w
            return tuple(map(float, out))
        use.remove(min(wrong, key=lambda k: w[use.index(k)]))


@dataclass
class Classifier:
    """Calibrated log-odds: combine[0] * content + combine[1] * page + combine[2]."""

    content: np.ndarray
    page: np.ndarray
    bias: tuple[float, float]
    combine: tuple[float, float, float]

    def odds(self, n: int, content: tuple[np.ndarray, np.ndarray], page: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.bincount(content[0], self.content[content[1]], n) + self.bias[0]
        b = np.bincount(page[0], self.page[page[1]], n) + self.bias[1]
        return a, b, self.combine[0] * a + self.combine[1] * b + self.combine[2]


class Training:
    """The two views' fits on labelled documents and on what they have been given."""

    def __init__(self, views: list[list[np.ndarray]], y: np.ndarray):
        self.y = y.astype(float)
        self.keep = np.arange(len(y)) % 4 != 3  # every fourth labelled document is kept back for calibration
        self.two_classes = len(y) > 0 and self.y.min() != self.y.max()
        self.given: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]  # label and features by document, for each view
        if self.two_classes:
            self.chosen = [choose([x for x, k in zip(v, self.keep, strict=True) if k], self.y[self.keep]) for v in views]
            self.own = [dense(v, c) for v, c in zip(views, self.chosen, strict=True)]
            self.train()

    def train(self) -> None:
        self.weights = []
        for own, chosen, given in zip(self.own, self.chosen, self.given, strict=True):
            more = dense([features for _, features in given.values()], chosen)
            labels = np.concatenate([self.y[self.keep], np.array([label for label, _ in given.values()])])
            self.weights.append(logistic(np.vstack([own[self.keep], more]), labels, np.concatenate([np.ones(int(self.keep.sum())), np.full(len(more), 0.5)])))

    def asked(self, size: int) -> tuple[int, int]:
        """How many new judgements of each class (0, 1) a view hands over in a round."""
        n, mean = max(1, int(SHARE * size)), self.y.mean()
        return min(MOST_GIVEN, max(1, int(n * (1 - mean)))), min(MOST_GIVEN, max(1, int(n * mean)))

    def teaches(self, i: int, label: float) -> bool:
        """Whether view i may hand over judgements of a class: on documents kept back its sure ones err a fifth as often,
        at most, as naming that class always would."""
        odds, y = self.own[i][~self.keep] @ self.weights[i], self.y[~self.keep]
        sure = odds >= _SURE_ODDS if label else odds <= -_SURE_ODDS
        return bool(sure.any()) and float((y[sure] != label).mean()) <= float((y != label).mean()) / 5

    def tables(self) -> list[np.ndarray]:
        out = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
        for table, c, w in zip(out, self.chosen, self.weights, strict=True):
            table[c] = w[:-1]
        return out

    def classifier(self) -> Classifier:
        y, keep = self.y, self.keep
        if not self.two_classes:
            constant = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
            return Classifier(np.zeros(BUCKETS), np.zeros(BUCKETS), (0.0, 0.0), (0.0, 0.0, float(np.log(constant / (1 - constant)))))
        kept = np.column_stack([np.clip(self.own[i][~keep] @ self.weights[i], -12, 12) for i in (0, 1)])
        combine = calibrated(kept, y[~keep]) if len(kept) > 10 else (0.5, 0.5, 0.0)
        tables = self.tables()
        return Classifier(tables[0], tables[1], (float(self.weights[0][-1]), float(self.weights[1][-1])), combine)


def co_train(views: list[list[np.ndarray]], y: np.ndarray, pool: list[list[np.ndarray]]) -> Classifier:
    """views and pool: for each of the two views the feature lists of the labelled and of the unlabelled documents."""
    training, size = Training(views, y), len(pool[0])
    for _ in range(ROUNDS if training.two_classes and size else 0):
        for i in (0, 1):
            odds = dense(pool[i], training.chosen[i]) @ training.weights[i]
            to = training.given[1 - i]
            for label, n, best in zip((0.0, 1.0), training.asked(size), (np.argsort(odds, kind="stable"), np.argsort(-odds, kind="stable")), strict=True):
                if not training.teaches(i, label):
                    continue
                sure = [int(j) for j in best if j not in to and (odds[j] >= _SURE_ODDS if label else odds[j] <= -_SURE_ODDS)]
                to.update((j, (label, pool[1 - i][j])) for j in sure[:n])
        training.train()
    return training.classifier()


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text_"), F.col("source").cast("string").alias("_source_"), F.col("lang").cast("string").alias("_lang_"), F.col("n_chars").cast("long").alias("_n_chars_"))


def fit(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic")) -> dict[str, Classifier]:
    """A classifier for each 0/1 column of labels. Documents with an id, a text and all labels count; repeated ids once.

    Fits on the MOST_LABELLED labelled documents whose ids hash lowest, a bounded sample. All documents without a label
    are judged in each round; the most confident ones, MOST_GIVEN of a class at most, join the fit.
    """
    return _trained(docs, labels, targets)[0]


def fit_and_score(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """doc_id and, for each target t, t_content, t_page, t_score of every row of docs, as score() gives them with fit()'s
    models. Texts are read once: what is scored are the chosen features that co-training has written."""
    models, features = _trained(docs, labels, targets)
    shipped = docs.sparkSession.sparkContext.broadcast(models)
    names = _score_names(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(np.repeat(np.arange(batch.num_rows), batch.column(c).value_lengths().to_numpy()), batch.column(c).flatten().to_numpy()) for c in ("content", "page")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_scores(shipped.value, batch.num_rows, *own)], ["doc_id", *names])

    return features.select("doc_id", "content", "page").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def _trained(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...]) -> tuple[dict[str, Classifier], DataFrame]:
    """The classifiers and the written rows (doc_id, has_text, content, page) of chosen features of all docs."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.col(t).cast("int")).alias(t) for t in targets]).dropna()
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    rows = _narrow(docs).withColumn("has_text", F.col("_text_").isNotNull().cast("int"))
    sample = rows.where("has_text = 1").join(F.broadcast(some), "doc_id")  # at most MOST_LABELLED ids
    once = _feature_rows(sample, targets).groupBy("doc_id").agg(F.min(F.struct(*targets, "content", "page")).alias("x")).select("doc_id", "x.*")
    found = once.toArrow()  # a row an id, however many rows have it
    order = np.argsort([zlib.crc32(str(i).encode()) for i in found.column("doc_id").to_pylist()], kind="stable")
    views = [[x[i] for i in order.tolist()] for x in (_lists(found, v) for v in ("content", "page"))]
    trainings = {t: Training(views, found.column(t).to_numpy()[order].astype(int)) for t in targets}
    del views, found
    teaching = [t for t in trainings.values() if t.two_classes]
    chosen = [np.unique(np.concatenate([np.zeros(0, np.int64), *(t.chosen[i] for t in teaching)])) for i in (0, 1)]
    features = common.materialise(_feature_rows(rows, ("has_text",), chosen), "features")
    _teach(teaching, features, known)
    return {t: training.classifier() for t, training in trainings.items()}, features


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    """The lists of a column as slices of one flat array."""
    out = []
    for chunk in table.column(name).chunks:
        offsets, flat = np.asarray(chunk.offsets), chunk.values.to_numpy()
        out += [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return out


def _feature_rows(rows: DataFrame, more: tuple[str, ...], chosen: list[np.ndarray] | None = None) -> DataFrame:
    """doc_id, the columns `more` (int), content and page (features) of _narrow's rows; of chosen features only, if given."""
    keep = None
    if chosen is not None:
        keep = [np.zeros(BUCKETS, bool) for _ in chosen]
        for mask, c in zip(keep, chosen, strict=True):
            mask[c] = True
    shipped = rows.sparkSession.sparkContext.broadcast(keep)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "_text_"):
                texts = common.texts_of(part, "_text_")
                lists = []
                for i, (doc, feature) in enumerate((content_features(texts), page_features(texts, *(part.column(c).to_pylist() for c in ("_source_", "_lang_", "_n_chars_"))))):
                    if shipped.value is not None:
                        doc, feature = doc[at := shipped.value[i][feature]], feature[at]
                    order = np.argsort(doc, kind="stable")
                    offsets = np.searchsorted(doc[order], np.arange(part.num_rows + 1)).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature[order].astype(np.int32))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[part.column(t) for t in more], *lists], ["doc_id", *more, "content", "page"])

    return rows.mapInArrow(features, "doc_id long, " + "".join(f"{t} int, " for t in more) + "content array<int>, page array<int>")


def _teach(trainings: list[Training], features: DataFrame, known: DataFrame) -> None:
    """The rounds of co-training over all unlabelled documents: a round writes every document's log-odds and takes the
    most confident by ordered limits. Ties go by hash of the id."""
    if not trainings:
        return
    pool = features.where("has_text = 1 and doc_id is not null").join(known.select("doc_id"), "doc_id", "left_anti")
    pool = common.materialise(pool.groupBy("doc_id").agg(F.min(F.struct("content", "page")).alias("x")).select("doc_id", "x.content", "x.page"), "unlabelled")
    size = pool.count()
    names = [[f"odds_{k}_{i}" for i in (0, 1)] for k in range(len(trainings))]
    for _ in range(ROUNDS if size else 0):
        judged = common.materialise(_judged(pool, trainings, [n for x in names for n in x]), "judged")
        taken: list[tuple[int, int, float, list[int]]] = []
        for k, training in enumerate(trainings):
            for i in (0, 1):
                odds, to = F.col(names[k][i]), training.given[1 - i]
                for label, n, sure, order in zip((0.0, 1.0), training.asked(size), (odds <= -_SURE_ODDS, odds >= _SURE_ODDS), (odds.asc(), odds.desc()), strict=True):
                    if not training.teaches(i, label):
                        continue
                    best = judged.where(sure).orderBy(order, F.xxhash64("doc_id"), "doc_id").limit(n + len(to)).select("doc_id").toPandas()["doc_id"]
                    taken.append((k, 1 - i, label, [d for d in best.tolist() if d not in to][:n]))
        ids = sorted({d for *_, some in taken for d in some})
        if not ids:
            break
        wanted = pool.sparkSession.createDataFrame([(d,) for d in ids], "doc_id long")
        got = pool.join(F.broadcast(wanted), "doc_id").toArrow()  # at most 4 * MOST_GIVEN ids a target
        lists = dict(zip(got.column("doc_id").to_pylist(), zip(_lists(got, "content"), _lists(got, "page"), strict=True), strict=True))
        for k, view, label, some in taken:
            for d in some:
                trainings[k].given[view].setdefault(d, (label, lists[d][view]))
        for training in trainings:
            training.train()


def _judged(pool: DataFrame, trainings: list[Training], names: list[str]) -> DataFrame:
    """doc_id and each view's log-odds of each training."""
    tables = [(("content", "page")[i], t.tables()[i], float(t.weights[i][-1])) for t in trainings for i in (0, 1)]
    shipped = pool.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = {c: np.repeat(np.arange(batch.num_rows), batch.column(c).value_lengths().to_numpy()) for c in ("content", "page")}
            flat = {c: batch.column(c).flatten().to_numpy() for c in ("content", "page")}
            odds = [pa.array(np.bincount(docs[c], table[flat[c]], batch.num_rows) + bias) for c, table, bias in shipped.value]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *odds], ["doc_id", *names])

    return pool.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def _score_names(models: dict[str, Classifier]) -> list[str]:
    return [f"{t}_{x}" for t in models for x in ("content", "page", "score")]


def _scores(models: dict[str, Classifier], n: int, content: tuple[np.ndarray, np.ndarray], page: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    """Probabilities of n documents, in the order of _score_names."""
    return [pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30)))) for m in models.values() for x in m.odds(n, content, page)]


def score(docs: DataFrame, models: dict[str, Classifier]) -> DataFrame:
    """row (all columns of docs as a struct) and, for each model t: t_content, t_page, t_score (probabilities).

    Null texts are empty, null metadata a value of its own; repeated rows give a row each; an empty table gives none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(models)
    names = _score_names(models)
    metadata = [F.col("source").cast("string").alias("_source_"), F.col("lang").cast("string").alias("_lang_"), F.col("n_chars").cast("long").alias("_n_chars_")]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "row.text"):
                texts = common.texts_of(part, "row.text")
                content = content_features(texts)
                page = page_features(texts, *(part.column(c).to_pylist() for c in ("_source_", "_lang_", "_n_chars_")))
                yield pa.RecordBatch.from_arrays([part.column("row"), *_scores(shipped.value, len(texts), content, page)], ["row", *names])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *[T.StructField(n, T.DoubleType()) for n in names]]))


def keeps() -> Column:
    """Whether a scored document stays: not clearly bad, not toxic."""
    return (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5)
