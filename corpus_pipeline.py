"""From raw documents to encoded ones: each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerelay.llm import byte_bpe, exact, language_id, mixing, simhash
from tablerelay.llm.common import quoted, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin stay; a missing label is filled in."""
    model = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"))))
    told = language_id.identified(docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), "text"), model).filter("not rejected")
    label = F.coalesce("row.lang", "lang_pred").alias("lang")
    return told.select(*(label if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source cut to the words taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts, with digests of the ids and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, ids=True).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: Compression, fingerprints and byte pairs are not for SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
