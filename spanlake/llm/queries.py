"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import COLLOCATIONS, SPELLING, URL_FILTER

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Arrow batches are bounded in bytes, not only in rows: texts may be very long.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_simhash import simhash_groups
    g = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op2_substring import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"), window=50, texts=False)


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_packing import pack
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0, with_ids=False)


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_tokenfile import read_tokens, write_tokens
    files = write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_tokens(files, with_ids=False)


@query("op9_ppm_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_ppm import scores
    return scores(table(spark, sf_dir, "documents"), order=5, fold=1)


@query("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_lines import drop_lines
    out = drop_lines(table(spark, sf_dir, "documents"), threshold=0.8)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_quality import quality
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, table(spark, sf_dir, "labels"), cut=0.3).select("doc_id", "held_out", "score", "predicted")


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_decontaminate import contamination
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_embedding_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_embeddings import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op7_url_filter", URL_FILTER)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_urls import judge
    return judge(table(spark, sf_dir, "pages"))


@query("op11_collocations", COLLOCATIONS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op11_collocations import collocations
    return collocations(table(spark, sf_dir, "documents"))


@query("op13_spelling_groups", SPELLING)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_spelling import spelling_groups
    return spelling_groups(table(spark, sf_dir, "documents"))


@query("op12_language_id")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op12_language import languages
    return languages(table(spark, sf_dir, "documents"))
