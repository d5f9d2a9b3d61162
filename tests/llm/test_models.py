"""Language mixture, co-training, mixing and language-model scores."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common, cotraining, language_mixture, mixing, ppm, queries

from .conftest import SF


# --- language mixture ---------------------------------------------------------------------------------------------------


def test_held_out_languages_are_found(spark, docs):
    found = queries.op10_language_mixture(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).head()
    assert right[0] > 0.98 and right[1] >= 0 and right[2] <= 1


def test_language_edge_cases(edge, docs):
    rows = language_mixture.identify(edge).collect()
    assert len(rows) == edge.count()
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (2, 3, 4, 10)] == ["und"] * 4 and by_id[2].score == 0
    model = language_mixture.fit(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    kept = language_mixture.predict(edge, model)
    assert kept.select("row.*").columns == edge.columns


def test_nothing_to_learn_from(none):
    assert language_mixture.fit(none).languages == []
    assert language_mixture.identify(none).count() == 0


def test_mixtures_are_found_and_em_equals_plain_loops(docs):
    model = language_mixture.fit(docs)
    rows = docs.where("n_chars between 400 and 3000").select("lang", "text").collect()
    of = {lang: next(r.text for r in rows if r.lang == lang and "###" not in r.text) for lang in ("de", "es")}
    names, score, shares = model.infer([of["de"] + " " + of["es"]])
    assert names[0] in ("de", "es") and 0.15 < shares[0][model.languages.index("de")] < 0.85 and abs(shares[0].sum() - 1) < 1e-4
    p = np.random.default_rng(1).random((9, 3)).astype(np.float32)
    share, ll = language_mixture._em(p, np.array([4, 5]), np.ones((2, 3), np.float32))
    for d, words in enumerate((p[:4], p[4:])):
        own = np.full(3, 1 / 3)
        for _ in range(language_mixture.ROUNDS):
            own = sum(w * own / (w * own).sum() for w in words) / len(words)
        assert np.allclose(own, share[d], atol=1e-4) and abs(sum(math.log((w * own).sum()) for w in words) - ll[d]) < 1e-3


def test_sets_of_all_languages_and_small_shares(docs):
    model = language_mixture.fit(docs)
    rows = docs.where("n_chars between 400 and 3000").select("lang", "text").collect()
    of = {lang: language_mixture.words_of(" ".join(r.text for r in rows if r.lang == lang and "###" not in r.text)) for lang in model.languages}
    every = " ".join(" ".join(of[lang][:100]) for lang in model.languages)
    small = " ".join((of["de"] * 100)[:4_900] + of["es"][:100])
    _, score, shares = model.infer([every, small])
    assert len(model.languages) == 4 and (shares[0] > 0.15).all() and score[0] < 1 / 3
    assert 0.005 < shares[1][model.languages.index("es")] < 0.04 and score[1] < 1
    df = docs.sparkSession.createDataFrame([(1, every), (2, None)], "doc_id long, text string")
    one, none = sorted(language_mixture.predict(df, model).collect(), key=lambda r: r.row.doc_id)
    assert one.languages == model.languages and abs(sum(one.shares) - 1) < 1e-4 and max(one.shares) == one.score
    assert none.languages == [] and none.shares == []


# --- co-training ----------------------------------------------------------------------------------------------------------


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = common.crc_of_id(F.col("doc_id")) % 5 != 1
    models = cotraining.fit(docs, labels.where(train))
    scored = cotraining.score(docs, models).select("row.doc_id", "quality_score", "toxic_score").join(labels.where(~train), "doc_id")
    rows = scored.collect()
    right = np.mean([(r.quality_score >= 0.5) == (r.quality == 1) for r in rows])
    clean = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert right > 0.9 and np.mean([r.quality_score >= 0.5 and r.toxic_score < 0.5 for r in clean]) > 0.95
    assert all(0 <= r.quality_score <= 1 for r in rows)


def test_classifier_edge_cases(spark, edge, none):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1), (5, None, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    models = cotraining.fit(edge, labels)
    scored = cotraining.score(edge, models)
    assert scored.count() == edge.count() and scored.select("row.*").columns == edge.columns
    assert cotraining.score(none, cotraining.fit(none, labels)).count() == 0
    assert cotraining.score(edge, cotraining.fit(edge, labels.where("false"))).where("quality_score = 0.5").count() == edge.count()


def test_scores_from_written_features_are_those_of_the_texts(spark, docs, edge):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1), (5, None, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for df, known in ((docs, spark.read.parquet(f"{SF}/labels.parquet")), (edge, labels)):
        want = cotraining.score(df, cotraining.fit(df, known)).select("row.doc_id", "quality_score", "toxic_page").collect()
        got = cotraining.fit_and_score(df, known).select("doc_id", "quality_score", "toxic_page").collect()
        key = lambda r: (r.doc_id is not None, r.doc_id or 0, round(r.quality_score, 9))
        assert [r.doc_id for r in sorted(got, key=key)] == [r.doc_id for r in sorted(want, key=key)]
        assert np.allclose([tuple(r)[1:] for r in sorted(got, key=key)], [tuple(r)[1:] for r in sorted(want, key=key)])


def test_views_teach_each_other():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    view = lambda base: [np.array([base + int(c), base + 10 + int(rng.integers(0, 50))]) for c in y]
    a, b = view(0), view(1000)
    model = cotraining.co_train([a[:80], b[:80]], y[:80], [a[80:240], b[80:240]])
    flat = lambda lists: (np.repeat(np.arange(len(lists)), 2), np.concatenate(lists))
    _, _, odds = model.odds(160, flat(a[240:]), flat(b[240:]))
    assert ((odds > 0) == (y[240:] == 1)).mean() > 0.97


def test_every_unlabelled_document_may_teach(spark):
    """Only documents whose ids hash high say clearly what a word means."""
    ids = spark.range(1_000, 5_300).orderBy(F.xxhash64("id"), "id").toPandas()["id"].tolist()
    rows = [(i, ("alpha" if i % 2 else "beta") + " common" + (" rare" if i < 24 or i in (25, 27) else ""), "en", "good" if i % 2 else "bad", 20) for i in range(200)]
    rows += [(i, "common words", "en", "unknown", 20) for i in ids[:4_000]]
    rows += [(i, "common rare" if k % 2 else "common other", "en", "good" if k % 2 else "bad", 20) for k, i in enumerate(ids[4_000:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    model = cotraining.fit(docs, labels)["quality"]
    alone = cotraining.fit(docs.where("doc_id < 200"), labels)["quality"]
    rare = cotraining._h("w", "rare")
    assert model.content[rare] > alone.content[rare] + 0.3


# --- mixing -----------------------------------------------------------------------------------------------------------------


def _expected_targets(size: dict) -> dict:
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight, total, out, capped = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(size.values()), {}, set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > 3 * size[s]}
        if not more:
            return {s: 3 * size[s] if s in capped else weight[s] * level for s in order}
        capped |= more


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_mix_meets_its_targets(which, request):
    import re

    df = request.getfixturevalue(which)
    size = collections.Counter()
    for r in df.select("source", "text").collect():
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want, got = _expected_targets(size), mixing.mix(df).collect()
    assert len(got) == df.count()
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_cube_keeps_balances():
    rng = np.random.default_rng(3)
    p, x = rng.random(500), rng.integers(1, 10_000, 500).astype(float)
    for step in (mixing.flight, mixing.settle_longest):
        q = step(p, x, np.random.default_rng(4))
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * x).sum() - (p * x).sum()) < 1e-3
    assert ((mixing.flight(p, x, np.random.default_rng(4)) % 1) > 0).sum() <= 2
    assert np.isin(mixing.land(mixing.flight(p, x, rng), x), [0, 1]).all()
    runs = np.mean([mixing.flight(np.full(40, 0.3), np.arange(40.0), np.random.default_rng(s)) for s in range(400)], axis=0)
    assert abs(runs - 0.3).max() < 0.12  # inclusion probabilities are kept


def test_mix_applied(edge, none, docs):
    copies = {(r.doc_id, r.key): 0 for r in mixing.mix(docs).collect()}
    for r in mixing.mix(docs).collect():
        copies[(r.doc_id, r.key)] += r.copies
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(copies.values())
    assert mixing.apply_mix(edge).columns == edge.columns
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).count() == 0


# --- prediction by partial matching -------------------------------------------------------------------------------------------


def test_rows_equal_but_for_their_source_are_mixed_apart(spark):
    rows = [(i, f"text number {i}", s) for i in range(50) for s in ("a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.source: r.n for r in mixing.mix(df).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    assert {r.source: r["count"] for r in mixing.apply_mix(df).groupBy("source").count().collect()} == taken and 30 <= taken["a"] <= 36


def _ppm_brute(texts: list[list[bytes]], order: int):
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in texts:
        s = bytes([ppm.BEFORE]) * order + b" ".join(t) + b"\xff"
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][s[i - k : i]][s[i]] += 1

    def log10(context: bytes, symbol: int) -> float:
        total, excluded = 0.0, set()
        for k in range(order, -1, -1):
            seen = {a: n for a, n in counts[k].get(context[len(context) - k :], {}).items() if a not in excluded}
            if not seen:
                continue
            n = sum(seen.values())
            if symbol in seen:
                return total + math.log10((seen[symbol] - 0.5) / n)
            total += math.log10(0.5 * len(seen) / n)
            excluded |= set(seen)
        return total - math.log10(256 - len(excluded))

    def text(t: list[bytes]) -> float:
        s = bytes([ppm.BEFORE]) * order + b" ".join(t) + b"\xff"
        return sum(log10(s[i - order : i], s[i]) for i in range(order, len(s)))

    return text


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_scores_equal_the_definition(which, request):
    df = request.getfixturevalue(which)
    df = df.where("doc_id is null or doc_id < 40 or doc_id >= 100") if which == "docs" else df.where(F.length("text").isNull() | (F.length("text") < 1000))
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    rows = [(r.doc_id, ppm.tokens_of(r.text or ""), r.h) for r in df.select("doc_id", "text", held.alias("h")).collect()]
    train = [t for _, t, h in rows if not h]
    c = collections.Counter(w for t in train for w in t)
    n, v, end = sum(c.values()) + len(train), len(c) + 1, len(train)
    brute, want = _ppm_brute(train, ppm.ORDER), collections.defaultdict(list)
    for i, t, h in rows:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t) + math.log10((end + 1) / (n + v + 1))
        want[i].append((h, len(t) + 1, sum(c[w] > 0 for w in t) + 1, n, base, brute(t) if which == "edge" or len(t) < 200 else None))
    got = ppm.score(df, held).collect()
    assert len(got) == len(rows)
    for r in got:
        assert any(
            tuple(r)[1:5] == w[:4] and abs(r.base_score - w[4]) < 1e-6 * abs(w[4]) and (w[5] is None or abs(r.score - w[5]) < 1e-5 * abs(w[5]) + 1e-6) for w in want[r.doc_id]
        ), r


def test_probabilities_sum_to_one(docs):
    texts = [ppm.tokens_of(r.text) for r in docs.select("text").limit(60).collect()]
    keys, n = ppm.summed(ppm.grams(texts, 3)[0])
    tries = ppm.levels(keys, n, 3, 0)
    for context in (b"the", b" on", b"qzx", bytes([ppm.BEFORE] * 3)):
        ask = np.array([int.from_bytes(context, "big") << 8 | s for s in range(256)])
        assert abs((10 ** ppm.code_lengths(ask, tries)).sum() - 1) < 1e-9


def test_score_edge_cases(edge, none):
    assert ppm.score(none, F.lit(False)).count() == 0
    nothing = ppm.score(edge.where(F.length("text") < 100), F.lit(True)).collect()
    assert all(abs(r.score + (r.n_tokens and math.log10(256) * (len(b" ".join(ppm.tokens_of(t))) + 1))) < 1e-3 for r, t in ((r, next(x.text for x in edge.where(F.col("doc_id").eqNullSafe(r.doc_id)).collect())) for r in nothing[:3]))


def test_lookup_finds_every_key():
    keys = np.unique(np.random.default_rng(2).integers(-(2**62), 2**62, 50_000))
    table = ppm.Lookup(keys, np.arange(len(keys)).astype(float))
    pick = np.random.default_rng(3).integers(0, len(keys), 10_000)
    assert (table.get(keys[pick]) == pick).all()
