"""A corpus pipeline over `documents`: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, common, cotraining, language_mixture, mixing, partenum

#: A document goes if no language has this share of it.
LEAST_SHARE = 0.3

#: SQL can express neither mixture inference nor co-training nor the cube method.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language for LEAST_SHARE at least, go."""
    common.small_batches(spark)
    model = language_mixture.fit(docs.where(~language_mixture.held_out(F.col("doc_id"))))
    found = language_mixture.predict(docs, model)
    return found.where((F.col("lang_pred") != language_mixture.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("row.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds bad or toxic go."""
    common.small_batches(spark)
    models = cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.score(docs, models).where(cotraining.keeps()).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the lowest id."""
    common.small_batches(spark)
    return partenum.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources come near their target weights."""
    common.small_batches(spark)
    return mixing.apply_mix(docs, weights=(1, 2, 3), most=3)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every document that the mix takes."""
    common.small_batches(spark)
    return byte_bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
