import datetime as dt

from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL
from spanlake.operators import explore as X
from spanlake.operators import metrics as M
from spanlake.operators import rollup as RU
from spanlake.sources.fixtures import call_logs


def test_summary_empty_range_is_one_zero_row(spark):
    logs = call_logs(spark, SMALL)
    r = M.summary(logs, "1h", as_of=dt.datetime(2030, 1, 1)).collect()
    assert len(r) == 1
    row = r[0]
    assert row["total_requests"] == 0 and row["error_rate"] == 0.0 and row["p50_latency_ms"] == 0
    assert row["total_cost_usd"] == 0.0


def test_range_param_check(spark):
    import pytest
    with pytest.raises(ValueError):
        M.summary(call_logs(spark, SMALL), "2d")
    with pytest.raises(ValueError):
        M.timeseries(call_logs(spark, SMALL), "nope", "24h")


def test_series_sum_equals_summary_count(spark):
    logs = call_logs(spark, MEDIUM)
    for rk in ("24h", "7d"):
        total = M.summary(logs, rk).collect()[0]["total_requests"]
        s = M.timeseries(logs, "requests", rk).agg(F.sum("v")).collect()[0][0]
        by = M.timeseries(logs, "requests", rk, "provider").agg(F.sum("v")).collect()[0][0]
        assert total == s == by


def test_rollup_reaggregates_to_direct_sums(spark):
    logs = call_logs(spark, MEDIUM)
    one_min = RU.rollup(logs)
    hourly = RU.reaggregate(one_min, "1 hour").orderBy("bucket", "provider", "model").collect()
    direct = RU.rollup(logs, "1 hour").orderBy("bucket", "provider", "model").collect()
    assert hourly == direct


def test_rollup_plus_tail_matches_direct(spark):
    logs = call_logs(spark, MEDIUM)
    t = RU.rollup_plus_tail(RU.rollup(logs), logs, "7d").collect()[0]
    s = M.summary(logs, "7d").collect()[0]
    assert t["total_requests"] == s["total_requests"]
    assert t["error_rate"] == s["error_rate"]
    assert t["avg_ttft_ms"] == s["avg_ttft_ms"]
    assert abs(t["total_cost_usd"] - s["total_cost_usd"]) < 1e-9


def test_keyset_ties(spark):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [(str(i), t0 if i < 4 else t0 - dt.timedelta(minutes=i)) for i in range(8)]
    base = spark.createDataFrame(rows, "id string, created_at timestamp_ntz")
    logs = base.select("id", "created_at", *[F.lit(None).cast("string").alias(c) for c in (
        "conversation_id", "provider", "model", "status", "input_preview", "output_preview", "error_type",
        "environment")], *[F.lit(1).alias(c) for c in (
        "latency_ms", "ttft_ms", "prompt_tokens", "completion_tokens", "total_tokens")],
        F.lit(None).cast("decimal(12,6)").alias("cost_usd"), F.lit(False).alias("streamed"),
        F.col("created_at").alias("started_at"), F.col("created_at").alias("ended_at"))
    page1 = X.logs_page(logs, 2).collect()
    assert [r["id"] for r in page1] == ["3", "2"]
    cur, cur_id = page1[0]["next_cursor"], page1[0]["next_cursor_id"]
    assert cur == t0 and cur_id == "2"
    kept = [r["id"] for r in X.logs_page(logs, 10, cursor=cur, cursor_id=cur_id).collect()]
    assert kept[:2] == ["1", "0"]
    strict = [r["id"] for r in X.logs_page(logs, 10, cursor=cur, cursor_id=cur_id, mode="reference").collect()]
    assert "1" not in strict and "0" not in strict
    last = X.logs_page(logs, 10).collect()
    assert all(r["next_cursor"] is None for r in last)


def test_log_detail_point_lookup(spark):
    d = X.log_detail(call_logs(spark, SMALL, previews=True), "5").collect()
    assert len(d) == 1 and d[0]["id"] == "5" and d[0]["request_payload"].startswith('{"messages":')


def test_filter_pushed_to_scan(spark):
    plan = M.summary(call_logs(spark, SMALL), "7d")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_histogram_percentiles_close_to_exact(spark):
    logs = call_logs(spark, MEDIUM)
    r = RU.rollup_with_histogram(logs)
    est = RU.approx_summary_from_rollups(RU.reaggregate_with_histogram(r, "1 hour"), "30d").collect()[0]
    exact = M.summary(logs, "30d").collect()[0]
    assert est["total_requests"] == exact["total_requests"]
    for q in ("p50", "p95", "p99"):
        e, a = exact[f"{q}_latency_ms"], est[f"{q}_latency_ms_approx"]
        assert abs(a - e) <= 0.2 * e + 1, (q, a, e)


def test_page_since_bounds_scan(spark):
    logs = call_logs(spark, SMALL, previews=True)
    full = X.logs_page(logs, 20).collect()
    since = full[-1]["created_at"] - dt.timedelta(seconds=1)
    bounded = X.logs_page(logs, 20, since=since)
    assert [r["id"] for r in bounded.collect()] == [r["id"] for r in full]
    assert "GreaterThanOrEqual(ts" in bounded._jdf.queryExecution().executedPlan().toString()


def test_summary_response_and_nested_series(spark):
    logs = call_logs(spark, MEDIUM)
    r = M.summary_response(logs, "7d").collect()
    assert len(r) == 1
    row = r[0]
    s = M.summary(logs, "7d").collect()[0]
    assert row["total_requests"] == s["total_requests"] and row["p95_latency_ms"] == s["p95_latency_ms"]
    assert sum(p["count"] for p in row["by_provider"]) == s["total_requests"]
    assert [m["count"] for m in row["by_model"]] == sorted([m["count"] for m in row["by_model"]], reverse=True)
    assert [(m["model"], m["count"]) for m in row["by_model"]] == \
        [(m["model"], m["count"]) for m in M.top_models(logs, "7d").collect()]
    assert {p["provider"]: p["error_rate"] for p in row["by_provider"]} == \
        {p["provider"]: p["error_rate"] for p in M.by_provider(logs, "7d").collect()}
    assert tuple(row)[:10] == tuple(s)
    nested = M.nest_series(M.timeseries(logs, "requests", "7d", "provider"), "6 hours").collect()
    total = sum(p["v"] for r in nested for p in r["points"])
    assert total == s["total_requests"]
    for r in nested:
        ts = [p["t"] for p in r["points"]]
        assert ts == sorted(ts)


def test_approx_percentiles_close(spark):
    logs = call_logs(spark, MEDIUM)
    e = M.summary(logs, "30d").collect()[0]
    a = M.summary(logs, "30d", approx=True).collect()[0]
    for q in ("p50", "p95", "p99"):
        assert abs(a[f"{q}_latency_ms"] - e[f"{q}_latency_ms"]) <= 0.02 * e[f"{q}_latency_ms"] + 2


def test_whole_payloads_and_pushed_key(spark):
    import json
    logs = call_logs(spark, SMALL, previews=True)
    plan = X.log_detail(logs, "42", stored_key="event_id")
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}[42]
    row = plan.collect()[0]
    assert json.loads(row.request_payload)["messages"][0]["content"] == text and len(text) > 512
    assert json.loads(row.response_payload)["content"] == text[256:]
    assert "EqualTo(event_id,42)" in plan._jdf.queryExecution().executedPlan().toString()
    assert X.log_detail(logs, "x42", stored_key="event_id").count() == 0


def test_histogram_has_no_ceiling(spark):
    from spanlake.operators.rollup import HIST_BOUNDS, latency_bucket
    values = [0, 1, 2_097_151, 2_097_152, 900_000_000, 2 ** 31 - 1, 10 ** 9, 2 ** 55]
    got = {r.v: r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", latency_bucket("v").alias("b")).collect()}
    assert got[2_097_152] < got[900_000_000] < got[2 ** 55]
    assert all(HIST_BOUNDS[b] <= v + 1 < HIST_BOUNDS[b + 1] for v, b in got.items())
