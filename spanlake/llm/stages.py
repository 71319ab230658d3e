"""Stages of the corpus pipeline: ``(spark, docs, sf_dir) -> DataFrame``.

Every stage works on all rows its predecessor kept and, but for the last, returns the columns of ``documents``.
Column values other than the text pass through unchanged; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op3_lines import drop_lines
from .op4_decontaminate import matches
from .op5_quality import quality
from .op6_packing import pack
from .op10_simhash import keep_one
from .queries import table, tokenizer_path
from .store import save

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, predicts as 0 go."""
    told = quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), cut=0.3)
    return told.where("predicted = 1").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go; a document all of whose lines went stays with an empty text."""
    out = drop_lines(docs.select(*COLUMNS), threshold=0.8, others=("lang", "source", "n_chars"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash groups with the contract's parameters; the smallest doc_id of each group stays."""
    return keep_one(docs, shingle=3, max_bits=2).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage aligned with a ``benchmark`` item go."""
    keyed = docs.select(*COLUMNS).withColumn("tid", F.xxhash64("text"))
    real = keyed.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "tid", "text")
    bad = matches(real, table(spark, sf_dir, "benchmark")).select("doc_id", "tid").distinct()
    return keyed.join(save(bad, "leaks"), ["doc_id", "tid"], "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0, with_ids=False)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack_sequences),
]


def run_stages(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in stages:
        docs = save(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs
