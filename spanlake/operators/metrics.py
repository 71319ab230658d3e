"""Dashboard metrics over the call fact table.

All aggregates are single-pass and partially aggregated map-side (count, sum,
avg, max) except the exact percentile, whose per-group state is a map of
distinct latency values -> count (bounded by the number of distinct ms values,
not by rows).  ``approx=True`` switches to ``percentile_approx`` (fixed-size
sketch) for very large groups.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import half_even_ratio, trunc_to_long
from ..schemas import DEFAULT_AS_OF, RANGE_BUCKET, RANGE_INTERVAL, TOP_MODELS

METRICS = ("requests", "latency_p50", "latency_p95", "errors", "cost", "tokens")
GROUP_BY = ("none", "provider", "model")


def check_range(range_key: str) -> str:
    """parameter domain check."""
    if range_key not in RANGE_INTERVAL:
        raise ValueError(f"range must be one of {sorted(RANGE_INTERVAL)}, got {range_key!r}")
    return range_key


def _ts_lit(df: DataFrame, col: str, value: _dt.datetime) -> Column:
    dtype = df.schema[col].dataType.simpleString()
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(dtype)


def in_range(logs: DataFrame, range_key: str = "24h", as_of: _dt.datetime = DEFAULT_AS_OF,
             time_col: str = "created_at", until: _dt.datetime | None = None) -> DataFrame:
    """``time_col >= as_of - interval`` (inclusive, no upper bound unless ``until``).

    The bound is computed on the driver into one literal, so it is pushed to the
    Parquet scan (and prunes date partitions when the table has a ``dt`` column).
    """
    lower = as_of - RANGE_INTERVAL[check_range(range_key)]
    out = logs.filter(F.col(time_col) >= _ts_lit(logs, time_col, lower))
    if "dt" in logs.columns:
        out = out.filter(F.col("dt") >= F.lit(lower.date()))
    if until is not None:
        out = out.filter(F.col(time_col) < _ts_lit(logs, time_col, until))
    return out


def is_error(status: str = "status") -> Column:
    """Only ERROR counts; CANCELLED and TIMEOUT do not."""
    return F.col(status) == F.lit("ERROR")


def _percentiles(col: str, qs: list[float], approx: bool) -> Column:
    if approx:
        return F.percentile_approx(col, qs, 10000)
    return F.percentile(col, qs)


def summary(logs: DataFrame, range_key: str = "24h", as_of: _dt.datetime = DEFAULT_AS_OF,
            approx: bool = False) -> DataFrame:
    """G1-G7 + P29: one row, also on an empty range (global aggregate)."""
    r = in_range(logs, range_key, as_of)
    agg = r.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_error()).alias("errors"),
        _percentiles("latency_ms", [0.5, 0.95, 0.99], approx).alias("pcts"),
        F.avg("ttft_ms").alias("avg_ttft"),
        F.sum("prompt_tokens").alias("sum_prompt"),
        F.sum("completion_tokens").alias("sum_completion"),
        F.sum("cost_usd").alias("sum_cost"),
    )
    return agg.select(
        F.lit(range_key).alias("range_name"),
        F.col("total").cast("long").alias("total_requests"),
        half_even_ratio(F.col("errors"), F.col("total"), 4).alias("error_rate"),
        trunc_to_long(F.col("pcts")[0]).alias("p50_latency_ms"),
        trunc_to_long(F.col("pcts")[1]).alias("p95_latency_ms"),
        trunc_to_long(F.col("pcts")[2]).alias("p99_latency_ms"),
        trunc_to_long(F.col("avg_ttft")).alias("avg_ttft_ms"),
        F.coalesce(F.col("sum_prompt").cast("long"), F.lit(0).cast("long")).alias("total_prompt_tokens"),
        F.coalesce(F.col("sum_completion").cast("long"), F.lit(0).cast("long")).alias("total_completion_tokens"),
        F.coalesce(F.col("sum_cost").cast("double"), F.lit(0.0)).alias("total_cost_usd"),
    )


def by_provider(logs: DataFrame, range_key: str = "24h", as_of: _dt.datetime = DEFAULT_AS_OF) -> DataFrame:
    """G8 + T6: count and unrounded error rate per provider, count desc."""
    r = in_range(logs, range_key, as_of)
    return (r.groupBy("provider")
            .agg(F.count(F.lit(1)).alias("count"), F.count_if(is_error()).alias("errors"))
            .select("provider", "count", (F.col("errors") / F.col("count")).alias("error_rate"))
            .orderBy(F.desc("count"), "provider"))


def top_models(logs: DataFrame, range_key: str = "24h", as_of: _dt.datetime = DEFAULT_AS_OF,
               k: int = TOP_MODELS) -> DataFrame:
    """G9 + T3: top-k models by count (tie-break by model name)."""
    r = in_range(logs, range_key, as_of)
    return (r.groupBy("model").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("model")).limit(k))


def errors_breakdown(logs: DataFrame, range_key: str = "24h", as_of: _dt.datetime = DEFAULT_AS_OF) -> DataFrame:
    """F6 + G14: ERROR rows with a known type -> count, last_seen; count desc."""
    r = in_range(logs, range_key, as_of).filter(is_error() & F.col("error_type").isNotNull())
    return (r.groupBy("error_type")
            .agg(F.count(F.lit(1)).alias("count"), F.max("created_at").alias("last_seen"))
            .orderBy(F.desc("count"), "error_type"))


def metric_expr(metric: str, approx: bool = False) -> Column:
    """The per-bucket value of one metric (NULL -> 0 applied by caller)."""
    if metric == "requests":
        return F.count(F.lit(1)).cast("double")
    if metric == "latency_p50":
        return F.round(_percentiles("latency_ms", [0.5], approx)[0], 6)
    if metric == "latency_p95":
        return F.round(_percentiles("latency_ms", [0.95], approx)[0], 6)
    if metric == "errors":
        return F.count_if(is_error()).cast("double")
    if metric == "cost":
        return F.sum("cost_usd").cast("double")
    if metric == "tokens":
        return F.sum("total_tokens").cast("double")
    raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")


def bucket_start(time_col: str, width: str) -> Column:
    """Epoch-aligned tumbling bucket (equal to date_bin from 2000-01-01 for the 4 widths)."""
    return F.window(F.col(time_col), width).start


def timeseries(logs: DataFrame, metric: str = "requests", range_key: str = "24h",
               group_by: str = "none", as_of: _dt.datetime = DEFAULT_AS_OF,
               approx: bool = False) -> DataFrame:
    """G10-G13 + T7: long series ``(t, series_key, v)``; sparse (no gap filling)."""
    if group_by not in GROUP_BY:
        raise ValueError(f"group_by must be one of {GROUP_BY}, got {group_by!r}")
    width = RANGE_BUCKET[check_range(range_key)]
    r = in_range(logs, range_key, as_of)
    t = bucket_start("created_at", width).alias("t")
    if group_by == "none":
        key = F.lit("all").alias("series_key")
        grouped = r.groupBy(t).agg(metric_expr(metric, approx).alias("v")).select("t", key, "v")
    else:
        k = F.coalesce(F.col(group_by).cast("string"), F.lit("None")).alias("series_key")
        grouped = r.groupBy(t, k).agg(metric_expr(metric, approx).alias("v"))
    return (grouped.select("t", "series_key", F.coalesce(F.col("v"), F.lit(0.0)).alias("v"))
            .orderBy("t", "series_key"))


def multi_metric_series(logs: DataFrame, range_key: str = "24h", group_by: str = "none",
                        as_of: _dt.datetime = DEFAULT_AS_OF, approx: bool = False) -> DataFrame:
    """All six metrics of one chart refresh in one scan and one aggregation."""
    width = RANGE_BUCKET[check_range(range_key)]
    r = in_range(logs, range_key, as_of)
    keys = [bucket_start("created_at", width).alias("t")]
    if group_by != "none":
        keys.append(F.col(group_by).cast("string").alias("series_key"))
    pct = _percentiles("latency_ms", [0.5, 0.95], approx)
    out = r.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("requests"), pct.alias("p"),
        F.count_if(is_error()).cast("double").alias("errors"),
        F.coalesce(F.sum("cost_usd").cast("double"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum("total_tokens").cast("double"), F.lit(0.0)).alias("tokens"))
    return out.select(*[c for c in out.columns if c != "p"],
                      F.round(F.col("p")[0], 6).alias("latency_p50"),
                      F.round(F.col("p")[1], 6).alias("latency_p95"))


def nest_series(long_series: DataFrame, bucket: str | None = None) -> DataFrame:
    """G13 nested form: one row per series key with ``points`` = [(t, v)] in time order.

    Arrays are bounded by the number of buckets of a range (at most 30 for the
    four fixed ranges), so collecting them per key is safe.
    """
    pts = F.array_sort(F.collect_list(F.struct(F.col("t"), F.col("v"))))
    out = long_series.groupBy("series_key").agg(pts.alias("points"))
    return out.withColumn("bucket", F.lit(bucket)) if bucket else out


def summary_response(logs: DataFrame, range_key: str = "24h", as_of: _dt.datetime = DEFAULT_AS_OF,
                     k: int = TOP_MODELS) -> DataFrame:
    """The summary endpoint's shape in one row: summary fields + ``by_provider`` + ``by_model``.

    One scan: grouping sets ``()``, ``(provider)`` and ``(model)`` in a single
    aggregation (the three separate queries of the endpoint share the filtered
    input), then a global fold of the few grouped rows into one row.
    """
    r = in_range(logs, range_key, as_of)
    g = r.groupingSets([[], ["provider"], ["model"]], "provider", "model").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_error()).alias("errors"),
        F.percentile("latency_ms", [0.5, 0.95, 0.99]).alias("pcts"),
        F.avg("ttft_ms").alias("avg_ttft"),
        F.sum("prompt_tokens").alias("sum_prompt"),
        F.sum("completion_tokens").alias("sum_completion"),
        F.sum("cost_usd").alias("sum_cost"))
    glob = F.col("gid") == 3
    prov = F.struct(F.col("total").alias("count"), F.col("provider"),
                    (F.col("errors") / F.col("total")).alias("error_rate"))
    mod = F.struct(F.col("total").alias("count"), F.col("model"))

    def by_count_desc(name: str):
        def cmp(a, b):
            return (F.when(a["count"] > b["count"], -1).when(a["count"] < b["count"], 1)
                    .when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(0))
        return cmp
    one = g.agg(
        F.max(F.when(glob, F.col("total"))).alias("total"),
        F.max(F.when(glob, F.col("errors"))).alias("errors"),
        F.max(F.when(glob, F.col("pcts"))).alias("pcts"),
        F.max(F.when(glob, F.col("avg_ttft"))).alias("avg_ttft"),
        F.max(F.when(glob, F.col("sum_prompt"))).alias("sum_prompt"),
        F.max(F.when(glob, F.col("sum_completion"))).alias("sum_completion"),
        F.max(F.when(glob, F.col("sum_cost"))).alias("sum_cost"),
        F.collect_list(F.when(F.col("gid") == 1, prov)).alias("bp"),
        F.collect_list(F.when(F.col("gid") == 2, mod)).alias("bm"))
    total = F.coalesce(F.col("total"), F.lit(0)).cast("long")
    return one.select(
        F.lit(range_key).alias("range_name"),
        total.alias("total_requests"),
        half_even_ratio(F.coalesce(F.col("errors"), F.lit(0)), total, 4).alias("error_rate"),
        trunc_to_long(F.col("pcts")[0]).alias("p50_latency_ms"),
        trunc_to_long(F.col("pcts")[1]).alias("p95_latency_ms"),
        trunc_to_long(F.col("pcts")[2]).alias("p99_latency_ms"),
        trunc_to_long(F.col("avg_ttft")).alias("avg_ttft_ms"),
        F.coalesce(F.col("sum_prompt").cast("long"), F.lit(0).cast("long")).alias("total_prompt_tokens"),
        F.coalesce(F.col("sum_completion").cast("long"), F.lit(0).cast("long")).alias("total_completion_tokens"),
        F.coalesce(F.col("sum_cost").cast("double"), F.lit(0.0)).alias("total_cost_usd"),
        F.array_sort("bp", by_count_desc("provider")).alias("by_provider"),
        F.slice(F.array_sort("bm", by_count_desc("model")), 1, k).alias("by_model"))
