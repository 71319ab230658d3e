"""Cost operators: C1-C4, J6.

* ``attach_cost``: recompute ``cost_usd`` from tokens with the fixed catalog
  (map-literal lookup, no join) or with a user catalog DataFrame (J6).
* ``join_prices``: J6 with a user catalog; how it joins is left to Spark and AQE,
  and a key that the catalog repeats counts once.
* ``backfill_tokens``: C4 as a column rewrite over the whole fact table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cost import call_cost, linear_cost, local_cost, rates_for, raw_cost
from ..functions.normalize import estimate_tokens
from ..sources.prices import COST_TYPE, LOCAL_DEFAULT_PER_MILLION, LOCAL_PROVIDER, LOCAL_TAG, RATE_TYPE, per_token

def attach_cost(logs: DataFrame, prices: DataFrame | None = None,
                provider_col: str = "provider_raw", out_col: str = "cost_usd") -> DataFrame:
    """Cost from tokens by raw provider + model."""
    if prices is None:
        return logs.withColumn(out_col, call_cost(provider_col, "model", "prompt_tokens",
                                                  "completion_tokens"))
    return join_prices(logs, prices, provider_col, out_col)


def join_prices(logs: DataFrame, prices: DataFrame, provider_col: str = "provider_raw",
                out_col: str = "cost_usd") -> DataFrame:
    """Equi left joins to a catalog DataFrame (price_key, local, input_rate, output_rate).

    A key that the catalog repeats counts once (its smallest rates), so calls never multiply; how the
    joins run is left to the planner.
    """
    cat = (prices.groupBy("price_key").agg(F.min(F.struct("local", "input_rate", "output_rate")).alias("p"))
           .select("price_key", "p.*"))
    p = F.lower(F.col(provider_col))
    m = F.lower(F.col("model"))
    base = (logs.withColumn("_k_cloud", F.concat(p, F.lit(":"), m))
            .withColumn("_k_base", F.substring_index(m, LOCAL_TAG, 1))
            .withColumn("_k_full", m))

    def side(name: str, local: bool) -> DataFrame:
        return cat.filter(F.col("local") == F.lit(local)).select(
            F.col("price_key").alias(f"_{name}_key"),
            F.struct(F.col("input_rate").cast(RATE_TYPE).alias("input_rate"),
                     F.col("output_rate").cast(RATE_TYPE).alias("output_rate")).alias(f"_{name}"))

    j = base
    for name, key, local in (("cloud", "_k_cloud", False), ("base", "_k_base", True),
                             ("full", "_k_full", True)):
        s = side(name, local)
        j = j.join(s, j[key] == s[f"_{name}_key"], "left").drop(f"_{name}_key")
    default = F.struct(F.lit(per_token(LOCAL_DEFAULT_PER_MILLION[0])).cast(RATE_TYPE).alias("input_rate"),
                       F.lit(per_token(LOCAL_DEFAULT_PER_MILLION[1])).cast(RATE_TYPE).alias("output_rate"))
    rates = F.when(p == LOCAL_PROVIDER, F.coalesce("_base", "_full", default)).otherwise(F.col("_cloud"))
    return (j.withColumn(out_col, linear_cost(rates, "prompt_tokens", "completion_tokens"))
            .drop("_k_cloud", "_k_base", "_k_full", "_cloud", "_base", "_full"))


def backfill_predicate(mode: str = "reference") -> Column:
    """rows the backfill rewrites."""
    missing = F.col("prompt_tokens").isNull() | F.col("cost_usd").isNull()
    if mode == "reference":
        return (F.col("provider") == "OTHER") & missing
    return (F.col("provider_raw") == LOCAL_PROVIDER) & missing


def backfill_tokens(logs: DataFrame, mode: str = "reference") -> DataFrame:
    """C4: estimated tokens (P28 over previews) and local-model cost.

    ``mode="reference"``: every OTHER row missing prompt tokens or cost gets all
    four values overwritten (cost rounded to 8 decimals, stored with 6).
    ``mode="fill"``: only raw provider ollama, and only NULL values are filled.
    Whole-table column rewrite: one map-side pass, no shuffle.
    """
    pred = backfill_predicate(mode)
    est_p = estimate_tokens("input_preview")
    est_c = estimate_tokens("output_preview")
    if mode == "reference":
        new_p, new_c = est_p, est_c
        new_t = est_p + est_c
        raw = raw_cost(rates_for(F.lit(LOCAL_PROVIDER), F.col("model")), est_p, est_c)
        new_cost = F.round(raw, 8).cast(COST_TYPE)
    else:
        new_p = F.coalesce(F.col("prompt_tokens"), est_p)
        new_c = F.coalesce(F.col("completion_tokens"), est_c)
        new_t = F.coalesce(F.col("total_tokens"), new_p + new_c)
        new_cost = F.coalesce(F.col("cost_usd"), local_cost(F.col("model"), new_p, new_c))
    return (logs.withColumn("_bf", pred)
            .withColumn("prompt_tokens", F.when(F.col("_bf"), new_p).otherwise(F.col("prompt_tokens")))
            .withColumn("completion_tokens", F.when(F.col("_bf"), new_c).otherwise(F.col("completion_tokens")))
            .withColumn("total_tokens", F.when(F.col("_bf"), new_t).otherwise(F.col("total_tokens")))
            .withColumn("cost_usd", F.when(F.col("_bf"), new_cost).otherwise(F.col("cost_usd")))
            .drop("_bf"))


def cost_by_model(logs: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Usage and recomputed cost per (raw provider, model)."""
    c = attach_cost(logs, prices, out_col="recomputed_cost")
    return (c.groupBy("provider_raw", "model")
            .agg(F.count(F.lit(1)).alias("calls"),
                 F.sum("prompt_tokens").cast("long").alias("prompt_tokens"),
                 F.sum("completion_tokens").cast("long").alias("completion_tokens"),
                 F.sum("recomputed_cost").cast("double").alias("cost_usd"),
                 F.count_if(F.col("recomputed_cost").isNull()).alias("unpriced_calls")))
