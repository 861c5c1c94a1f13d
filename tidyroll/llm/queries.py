"""Queries over the tables of a folder, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyroll.operators.staging import new_path

from . import (
    alignment,
    byte_bpe,
    decontamination,
    lm_scoring,
    merkle,
    quality,
    sharding,
    simhash,
    suffix_dedup,
    token_counts,
    token_store,
    topk,
    window_dedup,
)
from .texts import carried

END_ID = 2


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def encode_bytes(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = byte_bpe.digests(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return carried(found, "n_tokens", "ids_sha256", "decoded_sha256")


def store_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write(_table(spark, folder, "documents"), tokenizer, END_ID, path)
    return token_store.documents(spark, path)


def search(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"))


def score_entropy(spark: SparkSession, folder: str) -> DataFrame:
    found = lm_scoring.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return carried(found, "n_words", "target_loss", "background_loss", "score")


def grade_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return carried(found, "expected_grade", "p_1", "p_2", "keep")


def count_tokens(spark: SparkSession, folder: str) -> DataFrame:
    found = token_counts.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return carried(found, "n_bytes", "n_tokens", "over_limit")


def link_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def remove_strings(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, folder, "documents"))


def remove_windows(spark: SparkSession, folder: str) -> DataFrame:
    return window_dedup.digests(_table(spark, folder, "documents"))


def build_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.digests(_table(spark, folder, "documents"))


def align_tokenizers(spark: SparkSession, folder: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.align(_table(spark, folder, "documents"), *paths)
    return carried(found, *(c for c in found.columns if c != "row"))


def deal_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.digests(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate,
    "op2_byte_bpe": encode_bytes,
    "op3_token_store": store_tokens,
    "op4_topk": search,
    "op5_lm_scoring": score_entropy,
    "op6_quality": grade_quality,
    "op7_token_counts": count_tokens,
    "op8_simhash": link_simhash,
    "op9_suffix_dedup": remove_strings,
    "op10_window_dedup": remove_windows,
    "op11_merkle": build_manifest,
    "op12_alignment": align_tokenizers,
    "op13_sharding": deal_shards,
}
