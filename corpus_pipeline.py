"""The corpus pipeline: stages from raw documents to token ids."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyroll.llm import byte_bpe, decontamination, quality, simhash, suffix_dedup
from tidyroll.llm.texts import carried
from tidyroll.operators.staging import released, settled, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives the highest grade; toxic and poor ones go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    graded = quality.classify(docs, labels, carry=docs.columns)
    return carried(graded.where("keep"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.

    Rows without an id all stay, and rows that share an id stand or fall together.
    """
    groups = simhash.near_duplicates(docs, shingle=3, distance=3).where("doc_id is not null")
    least = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("least"))
    gone = least.where("not least").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 400-byte strings, as the operator removes them."""
    return suffix_dedup.cleaned(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.scan(docs, benchmark, carry=docs.columns)
    return found.where(F.size("hits") == 0).select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeats", repeats_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: A fitted classifier and exact components aren't SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again.

    A stage's input and what it staged itself are deleted when its result is written. With `folder`
    (shared by all executors, and used for one input only) the results of all stages are kept there,
    and a run that was broken off goes on behind the last stage that was written to its end.
    """
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, step) in enumerate(STAGES):
        if folder is None:
            docs = settled(spark, partial(step, spark, docs, sf_dir), f"pipeline-{name}", *read)
            read = [docs]
            continue
        path = f"{folder.rstrip('/')}/{i}-{name}"
        if not written(spark, path):
            with released(spark):
                step(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
