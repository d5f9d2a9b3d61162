from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use themselves.
EXTRA = ("key", "row", "score", "node", "size", "label", "n", "bucket", "block", "lang_pred", "held_out", "_text_", "_key_")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    long_ = " ".join(f"w{i % 977}" for i in range(40_000))
    texts = [
        (1, "One two three four five six seven.", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \n\t ", None, "a"), (None, "Null id text with several words here", "de", None),
        (5, long_, "en", "b"), (6, long_ + " tail", "en", "b"), (7, "One two three four five six seven.", "fr", "c"), (7, "One two three four five six seven.", "fr", "c"),
        (8, "x" * 60_000, "en", "c"), (9, "héllo wörld ñandú 漢字 \u0001 <|endoftext|> <s>", "de", "d"), (10, "12 34 !!", None, "d"), (100, "two three", "en", "a"), (200, None, "en", "a"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    rows = [(i, t, lang, s, None if t is None else len(t), *["z"] * len(EXTRA)) for i, t, lang, s in texts]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")
