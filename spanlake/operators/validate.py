"""Row validation with reasons (V1-V9).

Rules are ``(name, predicate)`` pairs; a row's ``reject_reasons`` is the array
of names whose predicate is not true (NULL counts as a failure).  One pass, no
shuffle: valid and rejected rows are two filters over the same projection, and
the accept/reject report is one small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import INFERENCE_STATUS, LENGTH_BOUNDS, MIN_ID_LENGTH

Rule = tuple[str, Column]


def with_reasons(df: DataFrame, rules: list[Rule], col: str = "reject_reasons") -> DataFrame:
    checks = [F.when(~F.coalesce(pred, F.lit(False)), F.lit(name)) for name, pred in rules]
    return df.withColumn(col, F.filter(F.array(*checks), lambda x: x.isNotNull()))


def split_valid(df: DataFrame, col: str = "reject_reasons") -> tuple[DataFrame, DataFrame]:
    """(accepted rows without the reasons column, rejected rows with reasons)."""
    return df.filter(F.size(col) == 0).drop(col), df.filter(F.size(col) > 0)


def reject_report(df: DataFrame, col: str = "reject_reasons") -> DataFrame:
    """V9: rows per reason; accepted rows counted under ``accepted``."""
    reasons = F.when(F.size(col) == 0, F.array(F.lit("accepted"))).otherwise(F.col(col))
    return (df.select(F.explode(reasons).alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("rows")))


def required(*cols: str) -> list[Rule]:
    """V1: fields that must be present."""
    return [(f"missing_{c.replace('.', '_')}", F.col(c).isNotNull()) for c in cols]


def call_event_rules(parsed: str = "e") -> list[Rule]:
    """V1-V7 for a parsed call event struct column ``parsed`` (see schemas.CALL_EVENT)."""
    e = lambda f: F.col(f"{parsed}.{f}")
    ts_ok = lambda f: F.try_to_timestamp(e(f)).isNotNull()
    lat = e("latency_ms").try_cast("int")
    rules: list[Rule] = [
        ("missing_id", e("id").isNotNull()),
        ("missing_provider", e("provider").isNotNull()),
        ("missing_model", e("model").isNotNull()),
        ("missing_status", e("status").isNotNull()),
        ("missing_started_at", e("started_at").isNotNull()),
        ("missing_ended_at", e("ended_at").isNotNull()),
        ("missing_latency_ms", e("latency_ms").isNotNull()),
        ("missing_request", e("request").isNotNull()),
        ("id_too_short", F.length(e("id")) >= MIN_ID_LENGTH),
        ("bad_started_at", ts_ok("started_at")),
        ("bad_ended_at", ts_ok("ended_at")),
        ("bad_latency_ms", lat.isNotNull()),
        ("negative_latency_ms", lat >= 0),
        ("bad_ttft_ms", e("ttft_ms").isNull() | e("ttft_ms").try_cast("int").isNotNull()),
        ("message_missing_field", F.coalesce(F.forall(
            e("request.messages"), lambda m: m["role"].isNotNull() & m["content"].isNotNull()), F.lit(True))),
        ("error_missing_field", e("error").isNull() |
         (e("error.type").isNotNull() & e("error.message").isNotNull())),
        ("bad_status", F.upper(F.coalesce(e("status"), F.lit("success"))).isin(*INFERENCE_STATUS)),
        ("bad_cost_usd", e("cost_usd").isNull() | e("cost_usd").try_cast("decimal(12,6)").isNotNull()),
    ]
    paths = {"error_type": "error.type"}
    for c, n in LENGTH_BOUNDS.items():
        v = e(paths.get(c, c))
        rules.append((f"{c}_too_long", v.isNull() | (F.length(v) <= n)))
    return rules


def raw_event_rules() -> list[Rule]:
    """Rules for the flat raw-event fixture (id, status, latency_ms)."""
    return [
        ("missing_id", F.col("id").isNotNull()),
        ("missing_latency_ms", F.col("latency_ms").isNotNull()),
        ("negative_latency_ms", F.col("latency_ms") >= 0),
        ("bad_status", F.upper(F.coalesce(F.col("status"), F.lit("success"))).isin(*INFERENCE_STATUS)),
    ]
