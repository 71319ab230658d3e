"""Span assembly: chunk events -> one call row per span.

Input: ``(span_id, seq, ts, delta, prompt_tokens, completion_tokens)`` plus
either ``kind`` (chunk / end / error / cancelled) or ``is_error``; optional
``error_type`` / ``error_message``.

* The first terminal event wins (A4); events after it are ignored.  A span
  without a terminal event ended with its stream (SUCCESS), or TIMEOUT when
  ``timeout`` is given and it has been idle longer than that at ``as_of``.
* TTFT counts only the first non-empty delta (A1); usage fields take the last
  non-NULL value each (A3); output is the ordered concatenation, cut to 2048
  code points (A2).

Scale: every per-span statistic is a map-side-combinable aggregate.  The
output text needs order, but only the first 2048 non-empty deltas can reach
the 2048-character cut, so the text is built from a per-span top-2048 (a
``row_number() <= k`` filter that Spark plans as a partial WindowGroupLimit
before the shuffle); a span with a third of all rows ships at most 2048 rows
per task.  Exact: every kept delta has at least one character.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import call_cost
from ..functions.normalize import provider_raw, total_tokens, truncate_request, truncate_response
from ..schemas import CALL_EVENT, DEFAULT_AS_OF, ERROR_MESSAGE_CHARS, RESPONSE_CONTENT_CHARS

END_KINDS = {"end": "SUCCESS", "error": "ERROR", "cancelled": "CANCELLED"}


def _with_kind(chunks: DataFrame) -> DataFrame:
    if "kind" in chunks.columns:
        return chunks
    return chunks.withColumn("kind", F.when(F.col("is_error"), F.lit("error")).otherwise(F.lit("chunk")))


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def assemble_spans(chunks: DataFrame, timeout: _dt.timedelta | None = None,
                   as_of: _dt.datetime = DEFAULT_AS_OF, max_chars: int = RESPONSE_CONTENT_CHARS) -> DataFrame:
    c = _with_kind(chunks)
    c = c.select("span_id", "seq", "ts", "delta", "prompt_tokens", "completion_tokens", "kind",
                 _opt(c, "error_type").alias("error_type"), _opt(c, "error_message").alias("error_message"))
    is_end = F.col("kind").isin(*END_KINDS)
    ends = (c.filter(is_end).groupBy("span_id")
            .agg(F.min_by(F.struct("seq", "ts", "kind", "error_type", "error_message"), "seq").alias("end")))
    kept = (c.join(ends, "span_id", "left")
            .filter(F.col("end").isNull() | (F.col("seq") <= F.col("end.seq"))))
    is_chunk = F.col("kind") == "chunk"
    stats = kept.groupBy("span_id").agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_ts"),
        F.min(F.when(is_chunk & (F.col("delta") != ""), F.col("ts"))).alias("first_token_ts"),
        F.max_by("prompt_tokens", F.when(F.col("prompt_tokens").isNotNull(), F.col("seq"))).alias("prompt_tokens"),
        F.max_by("completion_tokens", F.when(F.col("completion_tokens").isNotNull(), F.col("seq")))
         .alias("completion_tokens"),
        F.count_if(is_chunk).alias("chunk_count"),
        F.max("end").alias("end"))
    # A2: first max_chars non-empty deltas per span, then ordered concatenation.  The chunks
    # before the end are a seq-prefix, so the head is taken over all chunks (no join needed) and
    # cut at the end seq afterwards: exact.
    w = Window.partitionBy("span_id").orderBy("seq")
    head = (c.filter(is_chunk & (F.col("delta") != ""))
            .select("span_id", "seq", "delta")
            .withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= max_chars))
    heads = head.groupBy("span_id").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("__head"))
    s = stats.join(heads, "span_id", "left")
    before_end = F.filter("__head", lambda x: F.col("end").isNull() | (x["seq"] < F.col("end.seq")))
    s = s.withColumn("output_text", F.substring(F.array_join(F.transform(before_end, lambda x: x["delta"]), ""),
                                                1, max_chars))
    kind = F.col("end.kind")
    status = F.coalesce(
        F.when(kind == "error", F.lit("ERROR")).when(kind == "cancelled", F.lit("CANCELLED"))
         .when(kind == "end", F.lit("SUCCESS")),
        (F.when(F.col("last_ts") < F.lit((as_of - timeout).strftime("%Y-%m-%d %H:%M:%S"))
                .cast(chunks.schema["ts"].dataType), F.lit("TIMEOUT")) if timeout else F.lit(None)),
        F.lit("SUCCESS"))
    ended = F.coalesce(F.col("end.ts"), F.col("last_ts"))
    return s.select(
        "span_id", status.alias("status"), "started_at", ended.alias("ended_at"),
        F.floor((_micros(ended) - _micros(F.col("started_at"))) / 1000).cast("long").alias("latency_ms"),
        F.floor((_micros(F.col("first_token_ts")) - _micros(F.col("started_at"))) / 1000).cast("long")
         .alias("ttft_ms"),
        F.coalesce(F.col("output_text"), F.lit("")).alias("output_text"),
        "prompt_tokens", "completion_tokens",
        total_tokens("prompt_tokens", "completion_tokens").alias("total_tokens"),
        "chunk_count",
        F.when(kind == "error", F.col("end.error_type")).alias("error_type"),
        F.when(kind == "error", F.substring(F.col("end.error_message"), 1, ERROR_MESSAGE_CHARS)).alias("error_message"),
        F.lit(True).alias("streamed"))


def span_payloads(spans: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Payload record per span; context rows (span_id, conversation_id, session_id,
    default metadata, span metadata) are merged with span metadata winning."""
    out = spans
    if context is not None:
        out = out.join(context, "span_id", "left")
        if "default_metadata" in context.columns and "metadata" in context.columns:
            out = out.withColumn("metadata", F.map_concat(F.coalesce("default_metadata", F.create_map()),
                                                          F.coalesce("metadata", F.create_map())))
    return out.withColumn("response", F.struct(F.col("output_text").alias("content"),
                                               F.lit(None).cast("string").alias("finish_reason")))


def span_events(spans: DataFrame, context: DataFrame, out: str = "e") -> DataFrame:
    """Finished spans as call events (``event_id``, ``received_at``, ``e``), ready for ``ingest``.

    ``context``: ``(span_id, provider, model, request, conversation_id, session_id, metadata)``, one row per span.  Request
    contents are cut before anything else sees them (P17), the response likewise; the cost is that of the span's usage (C1).
    """
    s = spans.join(context, "span_id")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    none = lambda t: F.lit(None).cast(t)
    cost = call_cost(provider_raw("provider"), F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"))
    used = F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull()
    request = F.col("request")
    values = {
        "id": F.col("span_id"), "conversation_id": F.col("conversation_id"), "session_id": F.col("session_id"),
        "provider": F.lower("provider"), "model": F.col("model"), "status": F.lower("status"),
        "started_at": iso("started_at"), "ended_at": iso("ended_at"),
        "latency_ms": F.col("latency_ms").cast("string"), "ttft_ms": F.col("ttft_ms").cast("string"), "streamed": F.col("streamed"),
        "request": F.when(request.isNotNull(), request.withField("messages", truncate_request(request["messages"]))),
        "response": F.struct(truncate_response("output_text").alias("content"), none("string").alias("finish_reason")),
        "usage": F.when(used, F.struct(F.col("prompt_tokens"), F.col("completion_tokens"), none("int").alias("total_tokens"))),
        "cost_usd": cost.cast("double"),
        "error": F.when(F.col("error_type").isNotNull(), F.struct(
            F.col("error_type").alias("type"), F.coalesce("error_message", F.lit("")).alias("message"), none("string").alias("code"))),
        "metadata": F.col("metadata"),
    }
    event = F.struct(*[values.get(f.name, none(f.dataType)).cast(f.dataType).alias(f.name) for f in CALL_EVENT.fields])
    return s.select(F.xxhash64("span_id").alias("event_id"), F.col("ended_at").alias("received_at"), event.alias(out))
