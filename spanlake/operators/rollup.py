"""One-minute rollups and rollup + live-tail metrics.

A rollup row holds only additive state (counts and sums, incl. ``count_ttft``
so an average TTFT can be rebuilt), so coarser buckets and longer ranges are
re-aggregations of far fewer rows.  Exact percentiles are not additive; ranges
that need them aggregate the fact rows.  ``rollup_with_histogram`` adds a
log-spaced latency histogram (sparse map, 4 buckets per octave, additive) from which
``approx_summary_from_rollups`` estimates p50/p95/p99 without a fact scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import half_even_ratio, trunc_to_long
from ..schemas import DEFAULT_AS_OF, RANGE_INTERVAL
from .metrics import check_range, is_error

SUM_COLUMNS = ("count_total", "count_error", "sum_latency_ms", "count_ttft", "sum_ttft_ms",
               "sum_prompt_tokens", "sum_completion_tokens", "sum_cost_usd")


def rollup_aggs():
    return [
        F.count(F.lit(1)).alias("count_total"),
        F.count_if(is_error()).alias("count_error"),
        F.sum("latency_ms").cast("long").alias("sum_latency_ms"),
        F.count("ttft_ms").alias("count_ttft"),
        F.sum("ttft_ms").cast("long").alias("sum_ttft_ms"),
        F.sum("prompt_tokens").cast("long").alias("sum_prompt_tokens"),
        F.sum("completion_tokens").cast("long").alias("sum_completion_tokens"),
        F.sum("cost_usd").cast("decimal(14,6)").alias("sum_cost_usd"),
    ]


def rollup(logs: DataFrame, width: str = "1 minute", time_col: str = "created_at") -> DataFrame:
    """(bucket, provider, model) -> counts and sums; bucket = epoch-aligned window start."""
    return (logs.groupBy(F.window(time_col, width).start.alias("bucket"), "provider", "model")
            .agg(*rollup_aggs()))


def reaggregate(rollups: DataFrame, width: str, keys: tuple[str, ...] = ("provider", "model")) -> DataFrame:
    """Coarser buckets from finer rollup rows (sums of sums)."""
    return (rollups.groupBy(F.window("bucket", width).start.alias("bucket"), *keys)
            .agg(*[F.sum(c).cast("decimal(14,6)" if c == "sum_cost_usd" else "long").alias(c)
                   for c in SUM_COLUMNS]))


def rollup_plus_tail(rollups: DataFrame, logs: DataFrame, range_key: str = "7d",
                     as_of: _dt.datetime = DEFAULT_AS_OF, tail: _dt.timedelta = _dt.timedelta(hours=1),
                     width: _dt.timedelta = _dt.timedelta(minutes=1)) -> DataFrame:
    """Additive summary for a range = rollup rows before the cut + live aggregate after it.

    The cut is aligned to the rollup width; rollup buckets entirely inside the
    range are used (the range start is aligned to the same width), the fact
    table is scanned only for ``created_at >= cut``.
    """
    lower = as_of - RANGE_INTERVAL[check_range(range_key)]
    secs = int(width.total_seconds())
    align = lambda t: _dt.datetime.fromtimestamp(
        (int(t.replace(tzinfo=_dt.timezone.utc).timestamp()) // secs) * secs, _dt.timezone.utc).replace(tzinfo=None)
    cut = align(as_of - tail)
    if align(lower) != lower:
        raise ValueError("range start must be aligned to the rollup width")
    ts = lambda df, c, v: F.lit(v.strftime("%Y-%m-%d %H:%M:%S")).cast(df.schema[c].dataType)
    old = (rollups.filter((F.col("bucket") >= ts(rollups, "bucket", lower)) & (F.col("bucket") < ts(rollups, "bucket", cut)))
           .select(*SUM_COLUMNS))
    live = (logs.filter(F.col("created_at") >= ts(logs, "created_at", cut)).agg(*rollup_aggs()))
    return summary_from_sums(old.unionByName(live), range_key)


def summary_from_sums(rows: DataFrame, range_key: str) -> DataFrame:
    """The additive summary of a range from rows of ``SUM_COLUMNS``."""
    both = rows.agg(*[F.sum(c).alias(c) for c in SUM_COLUMNS])
    return both.select(
        F.lit(range_key).alias("range_name"),
        F.coalesce(F.col("count_total"), F.lit(0)).cast("long").alias("total_requests"),
        half_even_ratio(F.coalesce(F.col("count_error"), F.lit(0)),
                        F.coalesce(F.col("count_total"), F.lit(0)), 4).alias("error_rate"),
        trunc_to_long(F.col("sum_ttft_ms") / F.col("count_ttft")).alias("avg_ttft_ms"),
        trunc_to_long(F.col("sum_latency_ms") / F.col("count_total")).alias("avg_latency_ms"),
        F.coalesce(F.col("sum_prompt_tokens"), F.lit(0)).cast("long").alias("total_prompt_tokens"),
        F.coalesce(F.col("sum_completion_tokens"), F.lit(0)).cast("long").alias("total_completion_tokens"),
        F.coalesce(F.col("sum_cost_usd").cast("double"), F.lit(0.0)).alias("total_cost_usd"),
    )


# --- latency histogram (approximate percentiles from rollups) ----------------------------------

HIST_PER_OCTAVE = 4
HIST_BUCKETS = 62 * HIST_PER_OCTAVE  # every latency below 2^62 ms has its own bucket


def _bound(i: int) -> int:
    """Smallest integer n with n^4 >= 2^i, i.e. ceil(2^(i/4)), computed exactly."""
    n = int(round(2 ** (i / HIST_PER_OCTAVE)))
    while n ** HIST_PER_OCTAVE < 2 ** i:
        n += 1
    while n > 1 and (n - 1) ** HIST_PER_OCTAVE >= 2 ** i:
        n -= 1
    return n


# Bucket i holds latencies with BOUNDS[i] <= latency + 1 < BOUNDS[i + 1] (log-spaced, 4 per octave).
HIST_BOUNDS = tuple(_bound(i) for i in range(HIST_BUCKETS + 1))


def _bounds_lit() -> F.Column:
    return F.array(*[F.lit(b).cast("long") for b in HIST_BOUNDS])


def latency_bucket(col: str = "latency_ms") -> F.Column:
    """Bucket index on exact integer bounds: a log2 estimate corrected by one step either way."""
    x = F.greatest(F.col(col).cast("long"), F.lit(0).cast("long")) + 1
    est = F.least(F.greatest(F.floor(F.log2(x) * HIST_PER_OCTAVE).cast("int"), F.lit(0)), F.lit(HIST_BUCKETS - 1))
    b = _bounds_lit()
    lo_ok = F.element_at(b, est + 1) <= x
    idx = F.when(~lo_ok, est - 1).when(F.element_at(b, est + 2) <= x, est + 1).otherwise(est)
    return F.least(F.greatest(idx, F.lit(0)), F.lit(HIST_BUCKETS - 1))


def rollup_with_histogram(logs: DataFrame, width: str = "1 minute", time_col: str = "created_at", marks: bool = False) -> DataFrame:
    """G15 + ``latency_hist``: a sparse map bucket -> count, so coarse ranges can estimate percentiles.

    Two small aggregations instead of one wide one: first by (window, provider,
    model, latency bucket) with the additive rollup columns, then by (window,
    provider, model) summing them and collecting the (bucket, count)
    entries of the buckets that occur.  Both combine map-side.  ``marks`` adds
    ``mark``, the newest time of each bucket.
    """
    keys = ["bucket", "provider", "model"]
    lvl1 = (logs.withColumn("__hb", latency_bucket("latency_ms"))
            .groupBy(F.window(time_col, width).start.alias("bucket"), "provider", "model", "__hb")
            .agg(*rollup_aggs(), *([F.max(time_col).alias("mark")] if marks else [])))
    return lvl1.groupBy(*keys).agg(
        *[F.sum(c).cast("decimal(14,6)" if c == "sum_cost_usd" else "long").alias(c) for c in SUM_COLUMNS],
        F.map_from_entries(F.collect_list(F.struct(F.col("__hb"), F.col("count_total")))).alias("latency_hist"),
        *([F.max("mark").alias("mark")] if marks else []))


def merge_rollups(rows: DataFrame, keys: tuple[str, ...] = ("bucket", "provider", "model"), marks: bool = False) -> DataFrame:
    """Rollup rows of equal keys as one (sums of sums, histograms bucket by bucket); NULL keys are keys like others."""
    entries = rows.select(*keys, F.posexplode_outer("latency_hist").alias("__pos", "__hb", "__n"),
                          *[F.col(c) for c in SUM_COLUMNS], *(["mark"] if marks else []))
    # the sums of a row travel with its first histogram entry
    first = F.coalesce(F.col("__pos"), F.lit(0)) == 0
    per = entries.groupBy(*keys, "__hb").agg(
        F.sum("__n").alias("__n"), *[F.sum(F.when(first, F.col(c))).alias(c) for c in SUM_COLUMNS],
        *([F.max("mark").alias("mark")] if marks else []))
    return per.groupBy(*keys).agg(
        *[F.sum(c).cast("decimal(14,6)" if c == "sum_cost_usd" else "long").alias(c) for c in SUM_COLUMNS],
        F.map_from_entries(F.collect_list(F.when(F.col("__hb").isNotNull(), F.struct(F.col("__hb"), F.col("__n"))))).alias("latency_hist"),
        *([F.max("mark").alias("mark")] if marks else []))


def merged_histogram(rows: DataFrame, keys: list, hist_col: str = "latency_hist") -> DataFrame:
    """Sum sparse histograms per ``keys``: explode entries, add counts per bucket, collect again."""
    e = rows.select(*keys, F.explode(hist_col).alias("__hb", "__n"))
    per = e.groupBy(*keys, "__hb").agg(F.sum("__n").alias("__n"))
    return per.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("__hb").alias("idx"), F.col("__n").alias("n")))).alias("__entries"))


def reaggregate_with_histogram(rollups: DataFrame, width: str, keys: tuple[str, ...] = ("provider", "model")) -> DataFrame:
    """Coarser buckets: sums of sums, and histograms merged bucket by bucket."""
    b = rollups.withColumn("bucket", F.window("bucket", width).start)
    k = ["bucket", *keys]
    sums = b.groupBy(*k).agg(*[F.sum(c).cast("decimal(14,6)" if c == "sum_cost_usd" else "long").alias(c)
                               for c in SUM_COLUMNS])
    hist = merged_histogram(b, k).select(*k, F.map_from_entries("__entries").alias("latency_hist"))
    return sums.join(hist, k, "left")


def percentile_from_entries(entries: F.Column, q: float) -> F.Column:
    """Approximate continuous percentile from sorted (idx, n) entries: find the bucket holding rank
    q*(n-1) and interpolate linearly over its latency range [BOUNDS[i] - 1, BOUNDS[i+1] - 1)."""
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    rank = F.lit(q) * (total - 1)
    cum = F.transform(entries, lambda x, i: F.aggregate(F.slice(entries, 1, i + 1), F.lit(0).cast("long"),
                                                          lambda a, y: a + y["n"]))
    pos = F.array_position(F.transform(cum, lambda c: c > rank), True)  # 1-based entry past the rank
    hit = F.element_at(entries, pos.cast("int"))
    inside = hit["n"]
    before = F.element_at(cum, pos.cast("int")) - inside
    b = _bounds_lit()
    lo = (F.element_at(b, (hit["idx"] + 1).cast("int")) - 1).cast("double")
    hi = (F.element_at(b, (hit["idx"] + 2).cast("int")) - 1).cast("double")
    frac = (rank - before + 0.5) / inside
    return F.when(total > 0, lo + (hi - lo) * F.least(F.greatest(frac, F.lit(0.0)), F.lit(1.0)))


def approx_summary_from_rollups(rollups: DataFrame, range_key: str = "7d",
                                as_of: _dt.datetime = DEFAULT_AS_OF) -> DataFrame:
    """p50/p95/p99 estimates for a range from histogram rollups (no fact-table scan)."""
    lower = as_of - RANGE_INTERVAL[check_range(range_key)]
    lit = F.lit(lower.strftime("%Y-%m-%d %H:%M:%S")).cast(rollups.schema["bucket"].dataType)
    r = rollups.filter(F.col("bucket") >= lit).withColumn("__all", F.lit(1))
    h = merged_histogram(r, ["__all"])
    total = F.aggregate("__entries", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return h.select(F.lit(range_key).alias("range_name"), total.alias("total_requests"),
                    *[F.round(percentile_from_entries(F.col("__entries"), q), 6).alias(f"p{int(q * 100)}_latency_ms_approx")
                      for q in (0.5, 0.95, 0.99)])


# --- mergeable quantile sketches (G3, G16) -------------------------------------------------------

def rollup_with_sketch(logs: DataFrame, width: str = "1 minute", time_col: str = "created_at") -> DataFrame:
    """G15 + ``latency_kll``: a KLL sketch of the latencies, of bounded size whatever they are."""
    return (logs.groupBy(F.window(time_col, width).start.alias("bucket"), "provider", "model")
            .agg(*rollup_aggs(), F.kll_sketch_agg_bigint(F.col("latency_ms").cast("long")).alias("latency_kll")))


def reaggregate_with_sketch(rollups: DataFrame, width: str, keys: tuple[str, ...] = ("provider", "model")) -> DataFrame:
    """Coarser buckets: sums of sums and sketches merged; the result is of the same kind and can be merged again."""
    return (rollups.groupBy(F.window("bucket", width).start.alias("bucket"), *keys)
            .agg(*[F.sum(c).cast("decimal(14,6)" if c == "sum_cost_usd" else "long").alias(c) for c in SUM_COLUMNS],
                 F.kll_merge_agg_bigint("latency_kll").alias("latency_kll")))


def sketch_summary(rollups: DataFrame, range_key: str, as_of: _dt.datetime) -> DataFrame:
    """p50/p95/p99 of a range from sketches (about 1.3 % rank error at the sketch's default size, no ceiling of values);
    NULL without a call."""
    lower = as_of - RANGE_INTERVAL[check_range(range_key)]
    r = rollups.filter(F.col("bucket") >= F.lit(str(lower)).cast(rollups.schema["bucket"].dataType))
    all_of = r.agg(F.sum("count_total").alias("n"), F.kll_merge_agg_bigint("latency_kll").alias("s"))
    return all_of.select(F.lit(range_key).alias("range_name"), F.coalesce("n", F.lit(0)).cast("long").alias("total_requests"),
                         *[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("s", F.lit(q))).alias(f"p{int(q * 100)}_latency_ms_sketch")
                           for q in (0.5, 0.95, 0.99)])
