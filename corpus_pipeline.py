"""A training-data pipeline of corpus operators. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemion.llm.bpe import bpe_encode
from mnemion.llm.common import bucket_of_id, read, stage
from mnemion.llm.exact_dedup import drop_copies
from mnemion.llm.mixing import mix_sources
from mnemion.llm.near_dedup import drop_near_copies
from mnemion.llm.queries import tokenizer_path
from mnemion.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the grammar, learned from labels of rows that aren't held out, scores as toxic."""
    held_out = bucket_of_id(F.col("doc_id"), 5) == 0
    return drop_toxic(docs, train(docs.where(~held_out), read(spark, sf_dir, "labels").where(~held_out)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighted by the root of their size, shuffled."""
    return mix_sources(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_encode(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mix sources", mix), ("bpe", encode)]
#: The grammar's learned weights and the exact merges of BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written to the shared folder and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
