"""Fingerprints, similarity join, search and the pipeline against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import common, merkle, partenum, queries, wand

from .conftest import SF

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


# --- fingerprints ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_fingerprints(which, request, monkeypatch):
    monkeypatch.setattr(merkle, "RANGES_FOR", 20)
    df = request.getfixturevalue(which)
    rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, text) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(text) // 3
        want.append((str(i), len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    got = merkle.fingerprints(df).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_text = collections.defaultdict(set)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(set(texts[r.doc_id])) == 1:
            by_text[texts[r.doc_id][0]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len({next(iter(x)) for x in by_text.values()}) == len(by_text)


def test_likeness_follows_the_edit(spark):
    rows = queries.op1_merkle_fingerprints(spark, SF).where("n_chars > 500").collect()
    assert all(r.near_edited > r.near_next or r.near_next > 0.4 for r in rows)
    assert 0.55 < np.median([r.near_edited for r in rows]) < 0.8


def _tree(text):
    """The fingerprint in plain Python, and its nodes: hash of each section, paragraph and passage by place."""
    short = lambda x: format(xxhash.xxh64(x.encode(), seed=42).intdigest(), "016x")
    nodes, bodies = {}, []
    for i, section in enumerate(re.split(r"(?<=\n)(?=[ \t\r]*\n)", text)):
        parts = []
        for j, paragraph in enumerate(p for p in re.split(r"(?<=\n)", section) if p):
            leaves = [short(x)[4:] for x in re.findall(r"(?s)[^.!?]{1,32}[.!?]*|[.!?]+", paragraph)]
            nodes |= {(i, j, k): x for k, x in enumerate(leaves)}
            parts.append(short(" ".join(leaves)) + "," + " ".join(leaves))
            nodes[i, j] = parts[-1]
        bodies.append(short(";".join(parts)) + ":" + ";".join(parts))
        nodes[(i,)] = bodies[-1]
    body = "|".join(bodies)
    return hashlib.sha256(body.encode()).hexdigest() + "/" + body, nodes


def _differing(a, b):
    """Branches of a, and the numbers of passages that only a, only b has, from the nodes of two trees."""
    opened, moved = [{()}, {()}], set()
    for depth in (1, 2, 3):
        own = [{n: h for n, h in sorted(t.items()) if len(n) == depth and n[:-1] in o} for t, o in zip((a, b), opened, strict=True)]
        v, w = ([*x.values()] for x in own)
        front = next((k for k, (x, y) in enumerate(zip(v, w, strict=False)) if x != y), min(len(v), len(w)))
        back = next((k for k, (x, y) in enumerate(zip(v[front:][::-1], w[front:][::-1], strict=False)) if x != y), min(len(v), len(w)) - front)
        own = [dict([*x.items()][front : len(x) - back]) for x in own]
        v, w = ([*x.values()] for x in own)
        only = [{n for n, h in x.items() if h not in other} for x, other in zip(own, (w, v), strict=True)]
        out_of_order = {x for x, y in zip(dict.fromkeys(h for h in v if h in w), dict.fromkeys(h for h in w if h in v), strict=True) if x != y}
        moved |= {n for n, h in own[0].items() if h in out_of_order}
        opened = [o | x for o, x in zip(opened, only, strict=True)]
    told = (opened[0] - {()}) | moved
    branches = {n for n in told if len(n) == 3 or n in moved or not any(m != n and m[: len(n)] == n for m in told)}
    return {".".join(map(str, n)) for n in branches} or {"root"}, *[sum(len(n) == 3 for n in o) for o in opened]


def test_descent_agrees_with_a_plain_tree(spark):
    rng = random.Random(3)
    line = lambda: "".join(rng.choice(["one two. ", "A longer sentence of many words stands here! ", "Why? ", "x"]) for _ in range(rng.randint(1, 5)))
    section = lambda: "\n".join(line() for _ in range(rng.randint(1, 4)))
    pairs = []
    for _ in range(150):
        parts = [section() for _ in range(rng.randint(1, 5))]
        other = list(parts)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(other)) if other else 0
            match rng.randrange(5):
                case 0:
                    rng.shuffle(other)
                case 1:
                    other.insert(k, section())
                case 2:
                    del other[k : k + 1]
                case 3 if other:
                    other[k] = "\n".join(rng.sample(other[k].split("\n"), len(other[k].split("\n"))))
                case 4 if other:
                    other[k] = other[k].replace("two", "2", 1) + line()
        pairs.append(("\n\n".join(parts), "\n\n".join(other)))
    pairs += [("", ""), ("", "a"), ("a b c\n\n", ""), ("First.\nSecond.\n", "Second.\nFirst.\n"), ("x. x. y.", "x. y."), (pairs[0][0], pairs[1][0])]
    trees = spark.createDataFrame(pairs, "a string, b string").select("a", "b", merkle.fingerprint(F.col("a")).alias("x"), merkle.fingerprint(F.col("b")).alias("y")).repartition(4)
    rows = trees.select("*", merkle.compared(F.col("x"), F.col("y")).alias("c"), merkle.likeness(F.col("x"), F.col("y")).alias("like")).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        (x, a), (y, b) = _tree(r.a), _tree(r.b)
        assert (r.x, r.y) == (x, y) and r.like == r.c.likeness
        if x == y:
            assert (r.like, r.c.a_branches, r.c.b_branches) == (1, [], [])
            continue
        want, only_a, only_b = _differing(a, b)
        n = sum(len(m) == 3 for t in (a, b) for m in t)
        assert sorted(r.c.a_branches) == sorted(want) and sorted(r.c.b_branches) == sorted(_differing(b, a)[0])
        assert r.like == pytest.approx((n - only_a - only_b) / (n + 2)) and r.like < 1


def test_descent_locates_edits(spark):
    a = "Intro line.\nSecond line here.\n\nNew section. More text.\nLast line."
    others = [a.replace("Second line here", "Second line there"), "Second line here.\nIntro line.\n\nNew section. More text.\nLast line.", a.replace("More", "Much more"), a.replace("\nLast line.", ""), "Added.\n\n" + a]
    df = spark.createDataFrame([(i, a, b) for i, b in enumerate(others)], "i int, a string, b string")
    rows = df.select("i", merkle.compared(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("c")).orderBy("i").collect()
    assert [r.c.a_branches for r in rows] == [["0.1.0"], ["0.0", "0.1"], ["1.1.1"], ["1.1.2", "1.2.0"], ["0"]]
    assert all(0 < r.c.likeness < 1 for r in rows)


def test_fingerprints_of_nothing(none, edge):
    assert merkle.fingerprints(none).count() == 0
    one = merkle.fingerprints(edge.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_fingerprints_stay_native(spark, docs):
    plan = merkle.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- similarity join --------------------------------------------------------------------------------------------------------


def _sets(rows):
    out = []
    for i, t in rows:
        w = WORDS.findall((t or "").encode().lower())
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def _classes(rows):
    sets = _sets(rows)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(k)
    for k, (_, s) in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in where[g] if j < k).items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                parent[find(k)] = find(j)
    least, links = {}, collections.defaultdict(set)
    for k, (i, _) in enumerate(sets):
        least.setdefault(find(k), []).append(i)
    for k, (_, s) in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in where[g]).items():
            if sets[j][1] != s and 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                links[k].add(sets[j][1])
    return sorted(((i, len(s), min((x for x in least[find(k)] if x is not None), default=None) if s else i, len(links[k])) for k, (i, s) in enumerate(sets)), key=str)


def _random_copies(seed: int) -> list[tuple[int, str]]:
    """Copies with edits around the threshold, and unrelated texts that share a long passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([5, 8, 12, 30, 90, 300]))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy[: len(copy) - rng.randrange(0, 1 + len(copy) // 8)]))
    rows += [" ".join([*(word() for _ in range(rng.randrange(5, 40))), *passage, *(word() for _ in range(rng.randrange(5, 40)))]) for _ in range(60)]
    return list(enumerate(rows, 1))


def _got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in partenum.classes(df).collect()), key=str)


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_classes_equal_brute_force(which, request):
    df = request.getfixturevalue(which)
    assert _got(df) == _classes([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("small,sketched,compared", [(32, 2048, 384), (3, 2048, 384), (3, 5, 4), (2, 7, 2)])
def test_every_path_of_large_groups_is_exact(spark, monkeypatch, small, sketched, compared):
    monkeypatch.setattr(partenum, "SMALL", small)
    monkeypatch.setattr(partenum, "SKETCHED", sketched)
    monkeypatch.setattr(partenum, "COMPARED", compared)
    monkeypatch.setattr(partenum, "UNIT", 10)
    rows = _random_copies(small + sketched)
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == _classes(rows)


def test_every_link_of_a_group_of_many_parts_is_counted(spark, monkeypatch):
    monkeypatch.setattr(partenum, "COMPARED", 5)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(90)]
    rows = [(i, " ".join(f"x{i}" if k == at else w for k, w in enumerate(base))) for i in range(60) for at in [rng.randrange(90)]]
    rows += [(100 + i, " ".join([*base[:70], *(f"y{i}.{k}" for k in range(20))])) for i in range(20)]  # like the group in part
    want = _classes(rows)
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert min(links for i, _, _, links in want if i < 100) >= 59


def test_open_groups_are_joined_wherever_sketches_permit(spark):
    """Each of 30 groups: two large labels, which one pair of rows joins alone; lone rows make the lesser one the larger."""
    sketch = lambda x: bytes([x, *([1] * 63)])
    each = [(0, 0)] * 79 + [(0, 100)] + [(1, 120)] + [(1, 200)] * 63 + [(None, 220)] * 48
    rows = [(g, 1_000 * g + i, 1_000 * g + (i if label is None else 500 + label), x) for g in range(30) for i, (label, x) in enumerate(each)]
    nodes = spark.createDataFrame([(i, 100, sketch(x)) for _, i, _, x in rows], "node long, n long, sketch binary")
    labels = spark.createDataFrame([(i, label) for _, i, label, _ in rows], "node long, label long")
    members = spark.createDataFrame([(g, i) for g, i, _, _ in rows], "group long, node long")
    found, root = [(r.a, r.b) for r in partenum._open_edges(members, labels, nodes).collect()], {i: label for _, i, label, _ in rows}
    assert len(found) == 30 * 49
    for a, b in found:
        old, new = root[b], root[a]
        root = {i: new if label == old else label for i, label in root.items()}
    assert len(set(root.values())) == 30


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(7)
    rarity, tried = rng.integers(0, 255, 1 << 12).astype(np.uint8), 0
    for t in range(1_500):
        n = int(rng.integers(2, 60) if t % 2 else rng.integers(3, 900))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop, add = rng.integers(0, n // 7 + 2), rng.integers(0, n // 7 + 2)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if len(b) and not np.array_equal(a, b) and 4 * shared >= 3 * (len(a) + len(b) - shared):
            flat, sizes = np.concatenate([a, b]), np.array([len(a), len(b)])
            sigs, owners = partenum.signatures(flat, sizes, rarity)
            assert len(np.intersect1d(sigs[owners == 0], sigs[owners == 1]))
            assert partenum.difference(*partenum.sketches(flat, sizes)) <= len(a) + len(b) - 2 * shared
            assert partenum.shared([a], [b])[0, 0] == shared
            tried += 1
    assert tried > 1_000


def test_small_bands_enumerate_subsets_of_two_subparts():
    a = np.arange(1, 15, dtype=np.uint64)
    sigs, owners = partenum.signatures(partenum.mix(a), np.array([14]), np.zeros(8, np.uint8))
    band = int(np.searchsorted(partenum._BANDS, 14, side="right")) - 1
    assert len(sigs) == len(owners) == sum(3 * (int(partenum._MOST[j]) // 2 + 1) for j in (band, band + 1))


def test_sets_of_many_texts_are_those_of_each():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b c dd É ee".split()) for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 30]))) for _ in range(200)]
    flat, sizes = partenum.shingle_sets(texts)
    names, ends = partenum.set_keys(flat, sizes), np.cumsum(sizes)
    by = {}
    for k, (_, s) in enumerate(_sets(enumerate(texts))):
        assert sizes[k] == len(s) and (flat[ends[k] - sizes[k] : ends[k]] == partenum.shingles(texts[k])).all()
        assert by.setdefault(s, names[k]) == names[k]
    assert len(set(by.values())) == len(by)
    x = np.array([0, 1, 255, 256, 1 << 40], np.uint64)
    assert (partenum.unplanes(partenum.planes(x)) == x).all() and not len(partenum.unplanes(partenum.planes(x[:0])))


def test_rarity_ignores_how_counts_are_dealt(spark, docs):
    one, many = (partenum.rarity_table(partenum.node_rows(docs.repartition(n)).where("slice is not null").select("slice", "counts")) for n in (1, 5))
    assert (one == many).all() and one.max() > one.min()


def test_one_of_each(docs, edge, none):
    kept = partenum.one_of_each(docs)
    classes = partenum.classes(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.c for r in classes.select(F.col("component_id").alias("c")).distinct().collect())
    assert partenum.one_of_each(edge).columns == edge.columns and partenum.one_of_each(none).count() == 0 and partenum.classes(none).count() == 0


# --- search -----------------------------------------------------------------------------------------------------------------


def _search(rows, queries_, k):
    tok = [(i, (t or "").encode().lower().split()) for i, t in rows]
    n, mean = len(tok), sum(len(t) for _, t in tok) / max(len(tok), 1)
    df = collections.Counter(w for _, t in tok for w in set(t))
    out = {}
    for q, text in queries_:
        scores = []
        terms = set((text or "").encode().lower().split())
        for i, t in tok:
            c = collections.Counter(t)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in terms if w in c)
            if s:
                scores.append((i if i is not None else -(2**63), s))
        out[q] = sorted(scores, key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_search_equals_brute_force(which, request, monkeypatch):
    monkeypatch.setattr(wand, "SHARD_BYTES", 100_000)
    monkeypatch.setattr(wand, "ROUND_TERMS", 200)
    monkeypatch.setattr(wand, "DOCS_PER_BLOCK", 4)
    monkeypatch.setattr(wand, "BLOCKS_PER_WINDOW", 2)
    df = request.getfixturevalue(which)
    asked = df.where(F.col("doc_id") % (20 if which == "docs" else 1) == 0).where("doc_id not in (5, 6, 7)" if which == "edge" else "true")
    want = _search([(r.doc_id, r.text) for r in df.collect()], [(r.doc_id, r.text) for r in asked.collect()], 5)
    got = collections.defaultdict(list)
    for r in wand.search(df, asked.select(F.col("doc_id").alias("query_id"), "text"), k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for q, rows in want.items():
        assert [round(s, 7) for _, s in got[q]] == [round(s, 7) for _, s in rows]
        assert [i for i, _ in got[q]] == [i for i, _ in rows]


def test_a_task_holds_one_shard_at_a_time(spark, docs, monkeypatch):
    monkeypatch.setattr(wand, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(wand, "TERMS_HELD", 1_000)
    groups, plain, written = [], type(docs).mapInArrow, common.materialise

    def watched(df, f, schema, *args):
        def run(batches):
            def each():
                for batch in batches:
                    assert batch.num_rows == 1 or "df" not in batch.schema.names
                    yield batch

            return f(each())

        return plain(df, run, schema, *args)

    def noted(df, name, *args):
        table = written(df, name, *args)
        if name == "search-index":
            files = [pq.ParquetFile(x.removeprefix("file://")).metadata for x in table.inputFiles()]
            groups.append([m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)])
        return table

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    monkeypatch.setattr(common, "materialise", noted)
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    with common.arrow_rows(spark, 20):
        got = [(r.query_id, r.rank, r.doc_id, round(r.score, 7)) for r in wand.search(docs.coalesce(1), asked, k=5).collect()]
    assert len(groups) == 1 and len(groups[0]) > 5 and set(groups[0]) == {1}
    want = _search([(r.doc_id, r.text) for r in docs.collect()], [(r.query_id, r.text) for r in asked.collect()], 5)
    assert sorted(got) == sorted((q, n, i, round(x, 7)) for q, rows in want.items() for n, (i, x) in enumerate(rows, 1))


def _shard(texts: list[str]) -> wand.Shard:
    held = wand.Postings()
    for i, t in enumerate(texts):
        held.add(i, t)
    return wand.Shard(held.row(), float(np.mean(held.lengths)))


def _scores(shard, terms, idf, k):
    return shard.search(terms, idf, k, np.zeros(0, np.int64), np.zeros(0))


def test_pruning_skips_postings(monkeypatch):
    monkeypatch.setattr(wand, "DOCS_PER_BLOCK", 4)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, 30) % 2000) for _ in range(600)]
    terms = np.unique(wand.term_ids("t1 t2 t777 t42"))
    idf = rng.random(len(terms)) * 5
    all_, few = _shard(texts), _shard(texts)
    full, best = _scores(all_, terms, idf, 600), _scores(few, terms, idf, 7)
    assert (best[0] == full[0][:7]).all() and np.allclose(best[1], full[1][:7])
    assert all_.scored == sum(len(np.intersect1d(wand.term_ids(t), terms)) for t in texts)
    assert 0 < few.scored < 0.7 * all_.scored


def test_pivot_skips_windows_and_the_threshold_goes_from_shard_to_shard(monkeypatch):
    monkeypatch.setattr(wand, "DOCS_PER_BLOCK", 4)
    monkeypatch.setattr(wand, "BLOCKS_PER_WINDOW", 2)
    texts = ["common " * (1 + i % 5) + f"filler{i}" for i in range(400)] + ["common rare", "common rare rare"]
    terms, shard = np.unique(wand.term_ids("common rare")), _shard(texts)
    idf = np.where(terms == wand.term_ids("rare")[0], 9.0, 0.01)
    ids, scores = _scores(shard, terms, idf, 2)
    assert sorted(ids.tolist()) == [400, 401]
    again = _shard(texts[:400])
    assert again.search(terms, idf, 2, ids, scores)[0].tolist() == ids.tolist() and again.scored == 0


@pytest.mark.parametrize("seed", range(4))
def test_every_k_gives_the_head_of_the_full_list(seed, monkeypatch):
    monkeypatch.setattr(wand, "DOCS_PER_BLOCK", 3)
    monkeypatch.setattr(wand, "BLOCKS_PER_WINDOW", 4)
    rng = np.random.default_rng(seed)
    shard = _shard([" ".join(f"t{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 60)) % 300) for _ in range(300)])
    for _ in range(30):
        terms = rng.choice(shard.terms, min(len(shard.terms), int(rng.integers(1, 25))), replace=False)
        terms, idf = np.sort(terms), rng.random(len(terms)) * 6
        full, best = _scores(shard, terms, idf, 300), _scores(shard, terms, idf, k := int(rng.integers(1, 20)))
        assert best[0].tolist() == full[0][:k].tolist() and best[1].tolist() == full[1][:k].tolist()


def test_search_in_nothing(edge, none):
    assert wand.search(none, edge.select(F.col("doc_id").alias("query_id"), "text").dropna()).count() == 0
    assert wand.search(edge, none.select(F.col("doc_id").alias("query_id"), "text")).count() == 0


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = con.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


# --- the pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_copies", "mixing", "byte_bpe"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    now, ids = docs, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = common.materialise(stage(spark, now, SF), f"test-{name}")
        assert now.columns == docs.columns
        left = [r.doc_id for r in now.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids
        if name == "quality":
            clean = {i for i in ids if i in labels and labels[i].quality == 1 and labels[i].toxic == 0}
            assert len(clean & set(left)) >= 0.97 * len(clean) and len(left) < len(ids)
        ids = set(left)
    assert all(i == c and not links for i, _, c, links in _classes([(r.doc_id, r.text) for r in now.collect()]))
    mixed = corpus_pipeline.mix_sources(spark, now, SF)
    assert {r.doc_id for r in mixed.collect()} <= ids and mixed.columns == docs.columns
    assert corpus_pipeline.encode_bytes(spark, mixed, SF).count() == mixed.count()
