"""The corpus operators' queries over the given tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemion.llm.align import align
from mnemion.llm.ann import search
from mnemion.llm.bpe import bpe_encode
from mnemion.llm.common import bucket_of_id, read
from mnemion.llm.decontaminate import contamination
from mnemion.llm.decontaminate import oracle as contamination_oracle
from mnemion.llm.exact_dedup import exact_dedup
from mnemion.llm.filter_audit import filter_audit
from mnemion.llm.filter_audit import oracle as audit_oracle
from mnemion.llm.html_extract import extract_pages
from mnemion.llm.lm_score import lm_scores
from mnemion.llm.mixing import mix_sources
from mnemion.llm.mixing import oracle as mixing_oracle
from mnemion.llm.near_dedup import near_dedup
from mnemion.llm.pii import find_pii
from mnemion.llm.secrets import find_secrets
from mnemion.llm.toxicity import score_toxicity, train


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A parameter of the encoding operators; MNEMION_TOKENIZERS names another folder."""
    if folder := os.environ.get("MNEMION_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), words=2)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grammar is learned from the rows that aren't held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = bucket_of_id(F.col("doc_id"), 5) == 0
    grammar = train(docs.where(~held_out), labels.where(~held_out))
    return score_toxicity(docs.select("doc_id", "text", held_out.alias("held_out")), grammar, keep=("held_out",))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, repeated and shuffled."""
    docs = read(spark, sf_dir, "documents")
    return mix_sources(docs).select(*docs.columns, "copy", "copies", F.round("rate", 9).alias("rate"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"), bucket_of_id(F.col("doc_id"), 7) != 2)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(read(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_extract_pages": op1_extract_pages, "op2_near_dedup": op2_near_dedup, "op3_secrets": op3_secrets, "op4_nearest": op4_nearest, "op5_toxicity": op5_toxicity, "op6_mix_sources": op6_mix_sources, "op7_lm_scores": op7_lm_scores, "op8_bpe": op8_bpe, "op9_pii": op9_pii, "op10_exact_dedup": op10_exact_dedup, "op11_filter_audit": op11_filter_audit, "op12_decontamination": op12_decontamination, "op13_alignment": op13_alignment}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mix_sources": mixing_oracle(),
        "op10_exact_dedup": f"""
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256({LOWER}) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY {LOWER})""",
        "op11_filter_audit": audit_oracle(),
        "op12_decontamination": contamination_oracle(),
    }
