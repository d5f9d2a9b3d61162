"""Clustering, prefix trie and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm import exponion, fm_dedup, prefix_trie

from .conftest import EXTRA, SF


def rows_of(df, *key):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


# --- op12 -----------------------------------------------------------------------------------------------------------------


def lloyd(vectors, k, rounds, salt="3:"):
    """The contract word by word, in Python's integers. vectors: (vec_id, list)."""
    import math

    def usable(v):
        return v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if usable(v)]
    start = sorted(kept, key=lambda p: (hashlib.sha256((salt + ("" if p[0] is None else str(p[0]))).encode()).hexdigest(), p[1]))[:k]
    c = [list(v) for _, v in start]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(c)), key=lambda j: (d(v, c[j]), j))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)].append(v)
        for j, g in groups.items():
            c[j] = [sum(col) // len(g) for col in zip(*g, strict=True)]
    out = [(i, near(v), v) for i, v in kept]
    dist = [d(v, c[j]) for _, j, v in out]
    inertia = defaultdict(int)
    for (_, j, _), x in zip(out, dist, strict=True):
        inertia[j] += x
    return sorted(((i, j, x, inertia[j], sum(dist), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, j, _), x in zip(out, dist, strict=True)), key=lambda r: tuple((x is not None, x) for x in r))


def test_clusters_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert rows_of(exponion.cluster(table)) == lloyd([(r.vec_id, r.embedding) for r in table.collect()], 8, 10)


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = [rng.integers(-2, 3, 64).astype(float).tolist() for _ in range(12)]
    rows = [(i, base[i % 12]) for i in range(60)]  # ties and repeated vectors
    rows += [(5, base[3]), (5, base[3]), (None, base[1]), (70, None), (71, [1.0] * 63), (72, [1.0] * 65), (73, [float("nan")] * 64), (74, [float("inf")] + [0.0] * 63), (75, [None] + [0.0] * 63), (76, [])]
    rows += [(80 + i, (np.array(base[0]) * 300_000.0 + i).tolist()) for i in range(3)]  # beyond 32 bits
    schema = "vec_id long, embedding array<double>, " + ", ".join(f"`{c}` string" for c in (*EXTRA, "v", "u", "l", "cluster", "sums"))
    table = spark.createDataFrame([(*r, *["z"] * (len(EXTRA) + 5)) for r in rows], schema).repartition(5)
    assert rows_of(exponion.cluster(table)) == lloyd(rows, 8, 10)
    assert rows_of(exponion.cluster(table.where("vec_id in (1, 2)"))) == lloyd([r for r in rows if r[0] in (1, 2)], 8, 10)
    assert exponion.cluster(table.where("false")).collect() == []
    huge = spark.createDataFrame([(1, [1e12] * 64), (2, [-1e12] * 64), (3, [1e300] * 64)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in exponion.cluster(huge, k=1).collect()}
    assert set(got) == {1, 2} and got[1].distance == exponion.LONGEST


def test_search_scans_few_centroids():
    rng = np.random.default_rng(5)
    k, n = 64, 4_000
    centres = rng.integers(-1_000, 1_000, (k, 16))
    v = centres[rng.integers(0, k, n)] + rng.integers(-5, 6, (n, 16))
    brute = lambda c: np.array([((v[i] - c) ** 2).sum(1).argmin() for i in range(n)])
    cluster, u, low = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)
    before = None
    for step in range(3):
        now = (centres + step).tolist()
        looked = exponion.Centroids(now, before).assign(v, cluster, u, low)
        assert (cluster == brute(np.array(now))).all()
        before = now
        assert looked == n * k if step == 0 else looked < n * k / 20


# --- op11 -----------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    """The contract word by word. rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    sha = lambda node: hashlib.sha256(",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node)).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], sha(n)) for n, m in members.items()), key=lambda r: tuple((x is not None, x) for x in r))


def test_trie_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert rows_of(prefix_trie.trie(table)) == brute_trie([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])


@pytest.mark.parametrize(("block", "local"), [(4_096, 6), (3, 4)])
def test_trie_of_odd_conversations(spark, block, local):
    rng = random.Random(block + local)
    rows = [(None, 0, "user", "lost"), (-3, 0, "user", "a"), (-5, None, "user", "a"), (-5, 1, None, None), (7, 0, "u", ""), (7, 0, "u", ""), (8, None, None, "é漢")]
    for c in range(40):  # few texts: shared prefixes, copies, prefixes of others
        rows += [(c, t, rng.choice(["u", "a"]), rng.choice(["x", "xy"])) for t in range(rng.randrange(1, 14))]
    long_ = [rng.choice("pqr") for _ in range(25)]
    for c in (100, 105, 110, 115, 120):  # long copies, one that differs late, one that ends early
        rows += [(c, t, "u", x if (c, t) != (115, 22) else "z") for t, x in enumerate(long_[: 12 if c == 120 else 25])]
    names = (*EXTRA, "conv", "pos", "id", "nb", "ids", "path", "rep")
    schema = "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in names)
    table = spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], schema).repartition(4)
    assert rows_of(prefix_trie.trie(table, block, local)) == brute_trie([r for r in rows])


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(table).collect() == []
    lone = spark.createDataFrame([(3, 0, "u", "x")], table.schema)  # loses its only turn to an absent conversation
    assert rows_of(prefix_trie.trie(lone)) == brute_trie([(3, 0, "u", "x")])


# --- op13 -----------------------------------------------------------------------------------------------------------------


def brute_dedup(rows):
    """The contract word by word. rows: (doc_id, text), equal ids have equal texts."""
    words = [(t or "").encode().split() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    first, gone = {}, [set() for _ in rows]
    for i in order:
        for s in range(len(words[i]) - 19):
            at = first.setdefault(tuple(words[i][s : s + 20]), (rows[i][0], s))
            if at != (rows[i][0], s):
                gone[i].update(range(s, s + 20))
    out = [(d, len(w), len(g), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in g)).hexdigest()) for (d, _), w, g in zip(rows, words, gone, strict=True)]
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def passages(seed, n=60):
    """Documents with shared passages at any offset, near copies, copies, periodic texts and lines in other surroundings."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3) + rng.choice(["", "é", "x1"])
    line, long_ = [word() for _ in range(12)], [word() for _ in range(70)]
    texts = []
    for i in range(n):
        t = [word() for _ in range(rng.randrange(0, 80))]
        if i % 3 == 0:
            a = rng.randrange(40)
            t += long_[a : a + rng.randrange(15, 40)] + [word() for _ in range(10)]
        if i % 4 == 0:
            t = t[:30] + line + t[30:]
        if i % 7 == 0 and texts:
            t = list(texts[-1])
            for _ in range(2):
                if t:
                    t[rng.randrange(len(t))] = word()
        if i % 11 == 0:
            t = (["p", "q", "r"] * 30)[: 40 + i]
        if i % 13 == 0 and texts:
            t = list(texts[0])
        texts.append(t)
    return [rng.choice([" ", "\n", "\t "]).join(t) for t in texts]


def test_words_and_runs():
    import pyarrow as pa

    texts = ["", None, " a b\x0bc\x0c", "a", "b", "x\x1cy z w " * 30]
    words, counts = fm_dedup.words_of(pa.array(["skip", *texts]).slice(1))
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]
    assert words[0] == words[3] and words[1] == words[4] and len(set(words[:3].tolist())) == 3
    runs = fm_dedup.Runs(words, counts)
    assert runs.n.sum() == counts[5] - 19 and runs.n.max() <= fm_dedup.ANCHORS and set(runs.doc.tolist()) == {5}


def test_rank_and_backward_search():
    rng = np.random.default_rng(1)
    text = np.r_[rng.integers(1, 6, 400), 0, rng.integers(1, 6, 300), 0]
    tree = fm_dedup.WaveletMatrix(text, 6)
    c, i = rng.integers(0, 6, 500), rng.integers(0, len(text) + 1, 500)
    assert tree.rank(c, i).tolist() == [int((text[:b] == a).sum()) for a, b in zip(c, i, strict=True)]
    index = fm_dedup.FMIndex(text, 6)
    starts = np.arange(0, 380)
    for length in (1, 3, 7):
        where = {}
        for s in range(len(text) - length + 1):
            where.setdefault(text[s : s + length].tobytes(), []).append(s)
        statistic, low, high = index.matches(text, starts, length)
        for s, x, a, b in zip(starts, statistic, low, high, strict=True):
            there = where[text[s : s + length].tobytes()]
            assert (x == length) == (len(there) > 1)
            if x == length:
                assert sorted(index.places[a:b].tolist()) == there and index.earliest(np.array([a]), np.array([b]))[0] == there[0]


@pytest.mark.parametrize("hot", [fm_dedup.HOT, 1])
def test_repeated_passages(spark, hot):
    rows = list(enumerate(passages(hot))) + [(None, passages(1)[3] + " tail"), (500, None), (501, ""), (502, "a " * 19), (503, "a " * 30)]
    rows += [rows[9], rows[9]]  # repeated rows are one document
    names = (*EXTRA, "tkey", "place", "places", "h", "g", "words")
    table = spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names)).repartition(5)
    assert rows_of(fm_dedup.dedup(table, hot)) == brute_dedup(rows)


def test_repeated_passages_of_the_table(spark, docs, edge, none):
    assert rows_of(fm_dedup.dedup(docs)) == brute_dedup([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(fm_dedup.dedup(edge)) == brute_dedup([(r.doc_id, r.text) for r in edge.collect()])
    assert fm_dedup.dedup(none).collect() == []
