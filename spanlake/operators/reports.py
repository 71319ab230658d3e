"""Reports over the fact table and endpoint lists (R14 lives in redact; G18, G19, G21, T8, P18-P22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import (bedrock_region, endpoint_key, is_bedrock_url, model_family,
                              provider_from_base_url, provider_from_url)
from ..schemas import LIVE_FEED_SIZE
from .ingest import live_row


def model_catalog(logs: DataFrame, provider_col: str = "provider_raw") -> DataFrame:
    """Distinct models per provider key (sorted, comma-joined; bounded by distinct models)."""
    return (logs.select(provider_col, "model").distinct()
            .groupBy(provider_col).agg(F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"),
                                       F.count(F.lit(1)).alias("model_count")))


def duplicate_inputs(logs: DataFrame, hash_col: str = "input_hash") -> DataFrame:
    """Inputs seen more than once (count, first and last time)."""
    return (logs.filter(F.col(hash_col).isNotNull()).groupBy(hash_col)
            .agg(F.count(F.lit(1)).alias("calls"), F.min("created_at").alias("first_seen"),
                 F.max("created_at").alias("last_seen"))
            .filter(F.col("calls") > 1))


def live_feed(facts: DataFrame, n: int = LIVE_FEED_SIZE) -> DataFrame:
    """T8 + P13: the newest n lean rows (top-k, not a sort of the table)."""
    return live_row(facts).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def classify_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """P18-P21 as columns over a table of URLs."""
    p = provider_from_url(url_col)
    return df.select("*",
                     provider_from_base_url(url_col).alias("client_provider"),
                     p.alias("provider"),
                     is_bedrock_url(url_col).alias("is_bedrock"),
                     F.when(is_bedrock_url(url_col), bedrock_region(url_col)).alias("bedrock_region"),
                     endpoint_key(url_col, p).alias("endpoint_key"))


def model_families(df: DataFrame, model_col: str = "model") -> DataFrame:
    """P22 over a model column, counted."""
    return (df.groupBy(model_col).agg(F.count(F.lit(1)).alias("calls"))
            .withColumn("family", model_family(model_col)))


def dedupe_keys(df: DataFrame, key: str = "endpoint_key", order: str = "page_id",
                bucket_width: int = 1 << 14) -> DataFrame:
    """Repeated keys get suffixes _2, _3, ... in ``order`` (first keeps the key).

    Skew-safe rank: rows are cut into ranges of ``order`` (``bucket_width``);
    per (key, range) counts are prefix-summed over the ranges of a key (a small
    table), and the final ``row_number`` runs per (key, range), so a hot key is
    spread over many tasks.  Integral ``order`` values; rows without one come first.  A NULL key stays NULL.
    """
    b = df.withColumn("__b", F.floor(F.col(order) / bucket_width).cast("long"))
    counts = b.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    wk = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(wk), F.lit(0))).drop("__n")
    wr = Window.partitionBy(key, "__b").orderBy(order)
    o = offsets.select(F.col(key).alias("__key"), F.col("__b").alias("__range"), "__off")
    ranked = (b.join(o, F.col(key).eqNullSafe(F.col("__key")) & F.col("__b").eqNullSafe(F.col("__range")), "left")
              .drop("__key", "__range").withColumn("__rank", F.row_number().over(wr) + F.col("__off")))
    return (ranked.withColumn("dedup_key", F.when(F.col("__rank") == 1, F.col(key))
                              .otherwise(F.concat(F.col(key), F.lit("_"), F.col("__rank").cast("string"))))
            .drop("__b", "__off", "__rank"))
