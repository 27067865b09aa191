"""A corpus pipeline over ``documents``: filter, deduplicate twice, mix, encode.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from kinfold.llm.common import row_key, shared_folder, table

#: Documents at or above this probability go.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    weights = toxicity.fit(docs, labels)
    return docs.where(toxicity.score(weights) < TOXIC)


def _keeping(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` named by ``kept`` (row_key); repetitions of a row are merged first, so that no key is hot in the join."""
    rows = docs.select(F.struct("*").alias("row"), row_key(docs).alias("row_key")).dropDuplicates(["row_key"])
    return rows.join(kept.distinct(), "row_key", "left_semi").select("row.*")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return _keeping(docs, exact_dedup.keepers(docs))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near duplicates."""
    return _keeping(docs, near_dedup.keepers(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the digest of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix_sources), ("byte_bpe", encode)]

#: The classifier, the link search and the random rounding are no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
