"""Token operators against the libraries themselves."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import byte_bpe, orc_tokens, queries, token_counts

from .conftest import SF

WORD, PIECE, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def tik():
    with open(BYTE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def _key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_byte_bpe_equals_the_library(which, request, tik):
    df = request.getfixturevalue(which)
    want = []
    for i, text in _texts(df):
        ids = tik.encode_ordinary(text)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, byte_bpe.digest(df, BYTE).collect()), key=_key) == sorted(want, key=_key)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abstrevmld' \n\t .!1é²漢́", max_size=24), max_size=5))
def test_boundaries_follow_the_pattern(texts):
    import regex

    codec = byte_bpe.codec(BYTE)
    ids, n = codec.encode(texts)
    ends = np.cumsum(n)
    for text, a, b in zip(texts, [0, *ends], ends, strict=False):
        want = [i for piece in regex.findall(public_tokenizers.PATTERN, text) for i in byte_bpe.merge(piece.encode(), codec.ranks)]
        assert ids[a:b].tolist() == want
    assert [x.decode() for x in codec.decode(ids, n)] == texts


def test_scan_equals_sequential_composition():
    element, compose, _, identity = byte_bpe.monoid()
    rng = np.random.default_rng(1)
    for n in (1, 2, 127, 128, 129, 70_000):
        x = element[rng.integers(0, len(element), n)]
        got, state = byte_bpe.scan(x), identity
        for i in range(min(n, 2_000)):
            state = compose[state, x[i]]
            assert got[i] == state


def test_long_pieces_merge_like_short_ones(tik):
    ranks = byte_bpe.codec(BYTE).ranks
    for text in ("thethethe" * 60, "ab" * 300, "z" * 999, "".join(random.Random(3).choices("abc", k=777))):
        assert byte_bpe.merge(text.encode(), ranks) == tik.encode_ordinary(text)


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_token_counts_equal_the_library(which, request):
    df = request.getfixturevalue(which)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = [(i, len(t.encode()), n := len(model.encode(t)), n > 50) for i, t in _texts(df)]
    got = token_counts.count_tokens(df, PIECE, limit=50, table_rows=100)
    assert sorted(map(tuple, got.collect()), key=_key) == sorted(want, key=_key)


def test_token_counts_of_a_tokenizer_file(edge):
    model = tokenizers.Tokenizer.from_file(WORD)
    want = [(i, len(model.encode(t, add_special_tokens=False).ids)) for i, t in _texts(edge)]
    got = token_counts.count_tokens(edge, WORD).select("doc_id", "n_tokens")
    assert sorted(map(tuple, got.collect()), key=_key) == sorted(want, key=_key)


def test_frequent_pre_tokens_are_bounded_and_exact(docs):
    table = token_counts.frequent_pre_tokens(docs, PIECE, rows=50)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert len(table) == 50
    assert all(n == len(model.encode(p[1:])) for p, n in table.items() if p.startswith(" ") and p.strip() and not p.startswith("  "))


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_orc_round_trip(which, request):
    df = request.getfixturevalue(which)
    model = tokenizers.Tokenizer.from_file(WORD)
    stored = orc_tokens.round_trip(df, WORD, end_id=1).collect()
    texts = _texts(df)
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append([*model.encode(t, add_special_tokens=False).ids, 1])
    want = sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i in ids if i is not None for x in ids[i])
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in stored if r.doc_id is not None) == want
    in_order = sorted(stored, key=lambda r: r.start)
    assert [r.doc_id for r in in_order] == sorted((r.doc_id for r in stored), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in in_order] == [sum(x.n_tokens for x in in_order[:k]) for k in range(len(in_order))]


def test_orc_files_hold_indexes_and_filters(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    orc_tokens.write_tokens(docs, path, WORD)
    found = orc_tokens.read_tokens(spark, path, [5, 6])
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == [5, 6]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    raw = b"".join(p.read_bytes() for p in (tmp_path / "ids").glob("*.orc"))
    assert raw[:3] == b"ORC"


def test_empty_tables(none):
    assert byte_bpe.digest(none, BYTE).count() == 0
    assert token_counts.count_tokens(none, PIECE).count() == 0
    assert orc_tokens.round_trip(none, WORD).count() == 0


def test_registered_queries_give_a_row_for_each_document(spark, docs):
    for name in ("op2_orc_token_ids", "op3_token_counts", "op4_byte_bpe"):
        assert queries.queries()[name](spark, SF).count() == docs.count()
