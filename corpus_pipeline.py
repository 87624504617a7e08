"""From raw documents to token ids: five stages, each one operator of docsieve.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's ``docs``. All stages but the last
return the columns of ``docs``; all take null, empty and very long texts,
repeated rows, empty tables and further columns as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import bpe, mixing, quality_classifier, simhash, toxicity
from docsieve.llm.common import fresh, materialize, quoted

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAST_QUALITY, MOST_TOXIC = 0.3, 0.5


def _same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(quoted(c) for c in docs.columns))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least LEAST_QUALITY."""
    model = quality_classifier.learn(docs, _labels(spark, sf_dir))
    (name,) = fresh(docs, "score")
    return _same_columns(quality_classifier.score(docs, model).filter(F.col(name) >= LEAST_QUALITY), docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under MOST_TOXIC."""
    model = toxicity.learn(docs, _labels(spark, sf_dir))
    (name,) = fresh(docs, "score")
    return _same_columns(toxicity.score(docs, model).filter(F.col(name) < MOST_TOXIC), docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    return simhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source targets ask for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the bytes decoded from them."""
    return bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY).select(
        "doc_id",
        "lang",
        "source",
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("quality_classifier", quality), ("toxicity", clean), ("simhash_dedup", deduplicate), ("mixing", mix), ("byte_bpe", tokens)]

#: The classifiers, components and tokenizer are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
