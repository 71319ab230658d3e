"""Log explorer: filtered listings with keyset pages and point lookups.

F2-F4, P11-P12, T1-T2.  A page is ``filter -> orderBy -> limit(n+1)``, which
Spark plans as ``TakeOrderedAndProject``: every task keeps its own top n+1 and
only those rows reach the final merge, so a page costs one scan and no full
sort.  The has-more test and the cursor run over the n+1 rows only.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LOG_PAGE_MAX

LIST_COLUMNS = ("id", "conversation_id", "provider", "model", "status", "latency_ms", "ttft_ms",
                "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd", "streamed",
                "input_preview", "output_preview", "error_type", "environment", "started_at",
                "ended_at", "created_at")
DETAIL_EXTRA = ("request_payload", "response_payload", "pii_detections")


def _out_col(c: str) -> F.Column:
    if c == "conversation_id":
        return F.col(c).cast("string").alias(c)
    if c == "cost_usd":
        return F.col(c).cast("double").alias(c)
    return F.col(c)


def list_projection(logs: DataFrame) -> DataFrame:
    """19 columns; conversation id as text, decimal cost as double."""
    return logs.select(*[_out_col(c) for c in LIST_COLUMNS])


def detail_projection(logs: DataFrame) -> DataFrame:
    """P12 = P11 + request / response payload and detections."""
    return logs.select(*[_out_col(c) for c in LIST_COLUMNS + DETAIL_EXTRA])


def filter_logs(logs: DataFrame, provider: str | None = None, model: str | None = None,
                status: str | None = None, conversation_id=None) -> DataFrame:
    """optional equality conjuncts (provider / status compared upper-cased)."""
    out = logs
    if provider:
        out = out.filter(F.col("provider") == provider.upper())
    if model:
        out = out.filter(F.col("model") == model)
    if status:
        out = out.filter(F.col("status") == status.upper())
    if conversation_id is not None:
        out = out.filter(F.col("conversation_id") == F.lit(conversation_id).cast(
            logs.schema["conversation_id"].dataType))
    return out


def _ts(logs: DataFrame, value) -> F.Column:
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast(logs.schema["created_at"].dataType)


def after_cursor(logs: DataFrame, cursor, cursor_id: str | None = None,
                 mode: str = "default") -> DataFrame:
    """keyset cursor.

    ``mode="reference"`` keeps the strict ``created_at < cursor`` (rows that tie
    with the page's last row are skipped); the default continues after
    ``(cursor, cursor_id)`` in ``(created_at desc, id desc)`` order.
    """
    c = _ts(logs, cursor)
    if mode == "reference" or cursor_id is None:
        return logs.filter(F.col("created_at") < c)
    return logs.filter((F.col("created_at") < c) |
                       ((F.col("created_at") == c) & (F.col("id") < F.lit(cursor_id))))


def logs_page(logs: DataFrame, limit: int = 50, provider: str | None = None,
              model: str | None = None, status: str | None = None, conversation_id=None,
              cursor=None, cursor_id: str | None = None, mode: str = "default",
              since: _dt.datetime | None = None, enrich=None) -> DataFrame:
    """T1 + T2: newest-first page with ``next_cursor`` / ``next_cursor_id`` columns.

    ``next_cursor`` is the created_at of the last kept row when one more row
    exists, else NULL (same value on every row of the page).  ``since`` (not in
    the reference) bounds the scan from below; on a fact table partitioned by
    ``dt`` it also prunes older date folders, so a page reads recent data only.
    ``enrich`` adds columns that live elsewhere (previews) to the page's rows:
    the top is taken first, so at most ``limit + 1`` rows are joined.
    """
    if not 1 <= limit <= LOG_PAGE_MAX:
        raise ValueError(f"limit must be in 1..{LOG_PAGE_MAX}")
    f = filter_logs(logs, provider, model, status, conversation_id)
    if since is not None:
        f = f.filter(F.col("created_at") >= _ts(logs, since))
        if "dt" in logs.columns:
            f = f.filter(F.col("dt") >= F.lit(since.date()))
    if cursor is not None:
        f = after_cursor(f, cursor, cursor_id, mode)
        if "dt" in logs.columns and isinstance(cursor, _dt.datetime):
            f = f.filter(F.col("dt") <= F.lit(cursor.date()))
    order = [F.desc("created_at"), F.desc("id")]
    top = f.orderBy(*order).limit(limit + 1)
    top = list_projection(top if enrich is None else enrich(top))
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (top.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
              .withColumn("_n", F.count(F.lit(1)).over(w)))
    last_t = F.max(F.when(F.col("_rn") == limit, F.col("created_at"))).over(w)
    last_id = F.max(F.when(F.col("_rn") == limit, F.col("id"))).over(w)
    more = F.col("_n") > limit
    return (ranked.withColumn("next_cursor", F.when(more, last_t))
            .withColumn("next_cursor_id", F.when(more, last_id))
            .filter(F.col("_rn") <= limit).drop("_rn", "_n"))


def log_detail(logs: DataFrame, log_id: str, stored_key: str | None = None) -> DataFrame:
    """F4 + P12: point lookup by id.

    ``stored_key`` names the column that ``id`` is the text of, if the table stores the key in another type: it is
    compared in its own type, so the equality reaches the scan (and a join on it prunes the other side too).
    """
    hit = F.col("id") == F.lit(log_id)
    if stored_key:
        hit = hit & (F.col(stored_key) == F.lit(log_id).try_cast(logs.schema[stored_key].dataType))
    return detail_projection(logs.filter(hit))
