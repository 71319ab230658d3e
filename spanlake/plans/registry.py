"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB twins."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from ..functions.normalize import status_upper
from ..functions.normalize import total_tokens as _total_tokens
from ..functions.pii import PII_TYPES
from ..operators import conversations as CV
from ..operators import cost as C
from ..operators import explore as X
from ..operators import ingest as I
from ..operators import merge as MG
from ..operators import metrics as M
from ..operators import payloads as PL
from ..operators import redact as R
from ..operators import reports as RP
from ..operators import rollup as RU
from ..operators import spans as SP
from ..operators import validate as V
from ..operators.metrics import in_range
from ..schemas import DEFAULT_AS_OF, INFERENCE_STATUS
from ..session import scratch_path
from ..sources.events import batch_bodies, loose_payloads, parse_events, payloads_from_events, read_json_events
from ..sources.facts import find_by_id, write_by_id
from ..sources.fixtures import (MODEL_IDS, PLANTED_TEXT, URL_FORMS, call_logs, chunk_events, conversation_messages,
                                ended_chunks, provider_bodies, raw_events, span_context, with_previews)
from ..sources.prices import price_catalog
from ..sources.tables import read_table
from ..streaming import jobs as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# --- metrics -------------------------------------------------------------------------------

def _summary(rk):
    return lambda spark, sf: M.summary(call_logs(spark, sf), rk)


for _rk in ("1h", "24h", "7d", "30d"):
    register(f"summary_{_rk}", O.summary_sql(_rk))(_summary(_rk))

register("by_provider", O.by_provider_sql("7d"))(
    lambda spark, sf: M.by_provider(call_logs(spark, sf), "7d"))
register("top_models", O.top_models_sql("7d"))(
    lambda spark, sf: M.top_models(call_logs(spark, sf), "7d"))
register("errors_breakdown", O.errors_breakdown_sql("7d"))(
    lambda spark, sf: M.errors_breakdown(call_logs(spark, sf), "7d"))


def _ts(metric, rk, group_by):
    return lambda spark, sf: M.timeseries(call_logs(spark, sf), metric, rk, group_by)


for _m in M.METRICS:
    register(f"ts_{_m}", O.timeseries_sql(_m, "7d"))(_ts(_m, "7d", "none"))
register("ts_by_provider", O.timeseries_sql("requests", "24h", "provider"))(_ts("requests", "24h", "provider"))
register("ts_by_model", O.timeseries_sql("latency_p95", "30d", "model"))(_ts("latency_p95", "30d", "model"))
register("ts_requests_1h", O.timeseries_sql("requests", "1h"))(_ts("requests", "1h", "none"))
register("ts_cost_30d_by_provider", O.timeseries_sql("cost", "30d", "provider"))(_ts("cost", "30d", "provider"))


# --- log explorer --------------------------------------------------------------------------


def _page(spark, sf, limit, **args):
    return X.logs_page(call_logs(spark, sf), limit, enrich=lambda top: with_previews(spark, sf, top), **args)


register("logs_page", O.logs_page_sql(50))(
    lambda spark, sf: _page(spark, sf, 50))
register("logs_filtered", O.logs_page_sql(20, "provider = 'ANTHROPIC' AND status = 'ERROR'"))(
    lambda spark, sf: _page(spark, sf, 20, provider="anthropic", status="error"))
register("logs_next_page", O.logs_page_sql(
    100, "model = 'gpt-4o' AND created_at < TIMESTAMP '2024-01-15 00:00:00'"))(
    lambda spark, sf: _page(spark, sf, 100, model="gpt-4o", cursor="2024-01-15 00:00:00", mode="reference"))
register("logs_by_conversation", O.logs_page_sql(200, "conversation_id = 7"))(
    lambda spark, sf: _page(spark, sf, 200, conversation_id=7))
register("log_detail", O.log_detail_sql("42"))(
    lambda spark, sf: X.log_detail(call_logs(spark, sf, previews=True), "42", stored_key="event_id"))

# --- cost ----------------------------------------------------------------------------------

register("cost_by_model", O.cost_by_model_sql())(
    lambda spark, sf: C.cost_by_model(call_logs(spark, sf)))
register("cost_by_model_catalog", O.cost_by_model_sql())(
    lambda spark, sf: C.cost_by_model(call_logs(spark, sf), price_catalog(spark)))
register("backfill_tokens", O.backfill_sql("reference"))(
    lambda spark, sf: C.backfill_tokens(call_logs(spark, sf, previews=True), "reference").select(
        "id", "provider", "model", "prompt_tokens", "completion_tokens", "total_tokens",
        F.col("cost_usd").cast("double").alias("cost_usd")))
register("backfill_fill_nulls", O.backfill_sql("fill"))(
    lambda spark, sf: C.backfill_tokens(call_logs(spark, sf, previews=True), "fill").select(
        "id", "provider", "model", "prompt_tokens", "completion_tokens", "total_tokens",
        F.col("cost_usd").cast("double").alias("cost_usd")))

# --- PII -----------------------------------------------------------------------------------


def _redacted_docs(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return R.redact_column(docs, "text", "text_redacted", with_detections=False)


register("pii_redact_docs", O.pii_docs_sql())(
    lambda spark, sf: _redacted_docs(spark, sf).select(
        "doc_id", "text_redacted", *[f"pii_{n}" for n in PII_TYPES]))
register("pii_counts", O.pii_totals_sql())(lambda spark, sf: R.pii_totals(_redacted_docs(spark, sf)))


def _pii_messages(spark, sf):
    m = R.redact_column(conversation_messages(spark, sf), "content", "content_redacted",
                        with_detections=False)
    total = sum((F.col(f"pii_{n}") for n in PII_TYPES[1:]), F.col(f"pii_{PII_TYPES[0]}"))
    return m.select("conversation_id", "turn", "role", "content_redacted",
                    *[f"pii_{n}" for n in PII_TYPES], total.alias("pii_total"))


register("pii_messages", O.pii_messages_sql())(_pii_messages)


def _pii_report(spark, sf):
    # whole texts: the request is the document's text, the response its source line
    logs = read_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.array(F.struct(F.lit("user").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("content"),
                         F.lit(None).cast("string").alias("name"))).alias("messages"),
        F.col("source").alias("response_content"))
    return R.detection_report(R.redact_payload(logs, "messages", "response_content"))


register("pii_detection_report", O.pii_detection_report_sql())(_pii_report)

# --- validation / ingest / merge -----------------------------------------------------------


def _checked_raw(spark, sf):
    return V.with_reasons(raw_events(spark, sf), V.raw_event_rules())


register("validate_report", O.validate_report_sql())(lambda spark, sf: V.reject_report(_checked_raw(spark, sf)))


def _upsert_fold(spark, sf):
    ok, _ = V.split_valid(_checked_raw(spark, sf))
    facts = ok.select("id", "event_id", F.upper(F.coalesce("status", F.lit("success"))).alias("status"),
                      "latency_ms", "prompt_tokens", F.col("received_at").alias("created_at"))
    return MG.fold_latest(facts, "id", ["event_id"], mutable=("status", "prompt_tokens")).drop("event_id")


register("upsert_fold", O.upsert_fold_sql())(_upsert_fold)


def _raw_lifecycle(rows):
    checked = V.with_reasons(rows, V.raw_event_rules())
    ok = F.size("reject_reasons") == 0
    return checked.select("event_id", F.when(ok, F.lit("PROCESSED")).otherwise(F.lit("FAILED")).alias("status"),
                          F.when(~ok, F.array_join("reject_reasons", ",")).alias("error"))


register("replay_failed", O.replay_failed_sql())(
    lambda spark, sf: MG.replay_failed(raw_events(spark, sf), _raw_lifecycle(raw_events(spark, sf)),
                                       _raw_lifecycle))


def _ingest(spark, sf):
    raw = parse_events(payloads_from_events(read_table(spark, sf, "events")))
    return I.ingest(raw)


INGEST_COLS = ("id", "conversation_id", "provider", "provider_raw", "model", "status", "error_type",
               "latency_ms", "ttft_ms", "streamed", "prompt_tokens", "completion_tokens", "total_tokens",
               "input_preview", "output_preview", "environment", "created_at", "versions")


FOLD_INPUT = tuple(c for c in INGEST_COLS if c != "versions") + ("event_id",)

register("ingest_events", O.ingest_events_sql())(
    lambda spark, sf: MG.fold_latest(_ingest(spark, sf)[0].select(*FOLD_INPUT)).select(*INGEST_COLS))
register("event_status_counts", O.event_status_counts_sql())(
    lambda spark, sf: MG.event_status_counts(_ingest(spark, sf)[1]))
register("orphan_check", O.orphan_check_sql())(
    lambda spark, sf: MG.orphans(call_logs(spark, sf), read_table(spark, sf, "conversations"),
                                 "conversation_id", "conv_id").select("id", "conversation_id"))

# --- rollups / conversations ---------------------------------------------------------------


def _rollup_out(df):
    return df.withColumn("sum_cost_usd", F.col("sum_cost_usd").cast("double"))


register("rollup_1m", O.rollup_sql())(lambda spark, sf: _rollup_out(RU.rollup(call_logs(spark, sf))))
register("rollup_1h_from_1m", O.rollup_sql("INTERVAL 1 HOUR"))(
    lambda spark, sf: _rollup_out(RU.reaggregate(RU.rollup(call_logs(spark, sf)), "1 hour")))
register("rollup_plus_tail", O.rollup_plus_tail_sql("7d"))(
    lambda spark, sf: RU.rollup_plus_tail(RU.rollup(call_logs(spark, sf)), call_logs(spark, sf), "7d"))


def _convs(spark, sf):
    return CV.conversation_dim(conversation_messages(spark, sf), call_logs(spark, sf))


register("conversation_list", O.conversation_list_sql())(lambda spark, sf: CV.list_conversations(_convs(spark, sf)))
register("conversation_thread", O.conversation_thread_sql())(
    lambda spark, sf: CV.thread(_convs(spark, sf), conversation_messages(spark, sf)))
register("context_last_20", O.context_sql(20))(
    lambda spark, sf: CV.context_window(conversation_messages(spark, sf)))
register("last_message", O.last_message_sql())(lambda spark, sf: CV.last_message(conversation_messages(spark, sf)))
register("usage_per_conversation", O.usage_per_conversation_sql())(
    lambda spark, sf: CV.usage_per_conversation(call_logs(spark, sf), _convs(spark, sf)))


def _archive(spark, sf):
    logs = call_logs(spark, sf)
    hit = in_range(logs, "24h").filter(F.col("status") == "ERROR").select("conversation_id")
    return MG.archive(_convs(spark, sf), hit, DEFAULT_AS_OF).select("conversation_id", "status", "updated_at")


register("archive", O.archive_sql())(_archive)

# --- spans / reports / classification ------------------------------------------------------


def _with_input_hash(spark, sf):
    """Calls with the hash of their whole input text."""
    whole = read_table(spark, sf, "documents").select(F.col("doc_id").alias("event_id"), F.sha2(F.nullif("text", F.lit("")), 256).alias("input_hash"))
    return call_logs(spark, sf).join(whole, "event_id")


register("span_assembly", O.span_assembly_sql())(lambda spark, sf: SP.assemble_spans(chunk_events(spark, sf)))
register("model_catalog", O.model_catalog_sql())(lambda spark, sf: RP.model_catalog(call_logs(spark, sf)))
register("duplicate_inputs", O.duplicate_inputs_sql())(
    lambda spark, sf: RP.duplicate_inputs(_with_input_hash(spark, sf)))
register("live_feed_50", O.live_feed_sql(50))(lambda spark, sf: RP.live_feed(call_logs(spark, sf)))
register("classify_urls", O.classify_urls_sql())(
    lambda spark, sf: RP.classify_urls(read_table(spark, sf, "pages").select("page_id", "url")))
register("dedupe_endpoint_keys", O.dedupe_keys_sql())(
    lambda spark, sf: RP.dedupe_keys(RP.classify_urls(read_table(spark, sf, "pages").select("page_id", "url")))
    .select("page_id", "endpoint_key", "dedup_key"))
register("model_family", O.model_family_sql())(lambda spark, sf: RP.model_families(call_logs(spark, sf)))

# --- streaming -----------------------------------------------------------------------------


register("stream_rollup", O.rollup_sql())(lambda spark, sf: _rollup_out(ST.run_rollup(spark, sf)))
register("stream_series", O.timeseries_sql("requests", "24h", "provider"))(
    lambda spark, sf: ST.run_series(spark, sf, "24h", "provider"))
register("stream_upsert", O.ingest_events_sql())(
    lambda spark, sf: ST.run_upsert(spark, sf, fold_columns=FOLD_INPUT)[0].select(*INGEST_COLS))
register("stream_event_status", O.event_status_counts_sql())(
    lambda spark, sf: MG.event_status_counts(ST.run_upsert(spark, sf)[1]))
register("stream_live_feed", O.live_feed_sql(50))(lambda spark, sf: ST.run_live_feed(spark, sf, 50))
register("stream_spans", O.span_assembly_sql())(
    lambda spark, sf: ST.run_spans(spark, sf, timeout=_dt.timedelta(days=365)))

# --- heterogeneous payloads ----------------------------------------------------------------


def _bodies(spark, sf):
    n = PL.normalize_bodies(provider_bodies(spark, sf))
    return n.select("event_id", "provider", "model", F.size("messages").alias("n_messages"),
                    F.element_at("messages", -1)["content"].alias("last_content"), "prompt_tokens",
                    "completion_tokens", "output_text", "model_family",
                    F.array_join(F.transform("chat_messages", lambda m: m["role"]), ",").alias("chat_roles"),
                    "system_prompt")


register("normalize_bodies", O.normalize_bodies_sql())(_bodies)

# --- raw event normalisation / multi-metric series -----------------------------------------


def _normalize_events(spark, sf):
    r = raw_events(spark, sf)
    return r.select("event_id", F.lpad(F.col("id").cast("string"), 10, "0").alias("id"),
                    status_upper("status").alias("status"),
                    status_upper("status").isin(*INFERENCE_STATUS).alias("status_in_domain"),
                    F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"), "prompt_tokens",
                    _total_tokens("prompt_tokens", F.lit(None).cast("int")).alias("total_tokens"),
                    F.col("received_at").alias("created_at"))


register("normalize_events", O.normalize_events_sql())(_normalize_events)
register("ts_all_metrics", O.multi_series_sql("7d"))(
    lambda spark, sf: M.multi_metric_series(call_logs(spark, sf), "7d"))
register("event_lifecycle", O.event_lifecycle_sql())(
    lambda spark, sf: _ingest(spark, sf)[1].drop("reject_reasons"))
register("conversations_dim", O.conversations_dim_sql())(_convs)


def _pii_json_docs(spark, sf):
    docs = read_table(spark, sf, "documents")
    doc_json = F.to_json(F.struct(F.col("text").alias("body"),
                                  F.struct("lang", "source").alias("meta")))
    red = PL.redact_json(docs.select("doc_id", doc_json.alias("j")), "j", det_col="found")

    def count_of(name: str):
        of_type = F.filter("found", lambda d: d["type"] == name)
        return F.coalesce(F.aggregate(of_type, F.lit(0), lambda a, d: a + d["count"]), F.lit(0)).alias(f"pii_{name}")
    inside = F.from_json("j", "body string, meta struct<lang: string, source: string>")
    return red.select("doc_id", inside["body"].alias("body"), inside["meta"]["lang"].alias("lang"), inside["meta"]["source"].alias("source"),
                      *[count_of(n) for n in PII_TYPES])


register("pii_json_docs", O.pii_json_docs_sql())(_pii_json_docs)
register("approx_percentiles_from_rollups", O.approx_percentiles_sql("30d"))(
    lambda spark, sf: RU.approx_summary_from_rollups(
        RU.reaggregate_with_histogram(RU.rollup_with_histogram(call_logs(spark, sf)), "1 hour"), "30d"))

# --- spans that end in every way, stored rollup, loose types, parents ------------------------

register("stream_span_ends", O.ended_spans_sql())(
    lambda spark, sf: ST.run_spans(spark, sf, chunks=ended_chunks))


def _span_facts(spark, sf):
    chunks = ended_chunks(read_table(spark, sf, "events"))
    newest = chunks.agg(F.max("ts")).first()[0]
    spans = SP.assemble_spans(chunks, timeout=_dt.timedelta(days=1, minutes=10), as_of=newest)
    facts, _ = I.ingest(SP.span_events(spans, span_context(chunks)))
    return facts.select("id", "status", "error_type", "error_message", "latency_ms", "ttft_ms", "prompt_tokens", "completion_tokens",
                        "total_tokens", F.col("cost_usd").cast("double").alias("cost_usd"), "input_preview", "output_preview",
                        "request_payload", "input_hash", "pii_detections", "created_at")


register("span_facts", O.span_facts_sql())(_span_facts)


def _stored_rollup(spark, sf):
    store = ST.run_stored_rollup(spark, sf, until=DEFAULT_AS_OF - _dt.timedelta(hours=1))
    return store.summary(call_logs(spark, sf), "7d", DEFAULT_AS_OF)


register("rollup_stored_plus_tail", O.rollup_plus_tail_sql("7d"))(_stored_rollup)


def _loose(spark, sf):
    facts, life = I.ingest(parse_events(loose_payloads(read_table(spark, sf, "events"))))
    facts = facts.select("event_id", "streamed", "prompt_tokens", F.col("cost_usd").cast("double").alias("cost_usd"))
    return life.select("event_id", "status", "error").join(facts, "event_id", "left")


register("ingest_loose_types", O.loose_types_sql())(_loose)


def _json_files(spark, sf):
    path = scratch_path(spark, "json-bodies")
    batch_bodies(read_table(spark, sf, "events")).write.text(path)
    return MG.event_status_counts(I.ingest(read_json_events(spark, path, batched=True), redact=False)[1])


register("ingest_json_files", O.event_status_counts_sql())(_json_files)


def _replay_parents(spark, sf):
    convs = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("conversation_id")).distinct()
    root = scratch_path(spark, "replay-parents")
    ST.run_upsert(spark, sf, root=root, parents=lambda: convs.where("conversation_id % 3 <> 0"))
    return ST.replay_events(spark, root, parents=convs)[1].select("event_id", "status", "error", "attempts")


register("replay_parents", O.replay_parents_sql())(_replay_parents)
# randomised sketches have no SQL twin; tests hold their rank error against exact percentiles
register("sketch_percentiles_from_rollups")(
    lambda spark, sf: RU.sketch_summary(RU.reaggregate_with_sketch(RU.rollup_with_sketch(call_logs(spark, sf)), "1 hour"), "30d", DEFAULT_AS_OF))

# --- stored lookup, micro-batches by events, rows that reach every branch -----------------------------


def _log_detail_stored(spark, sf):
    path = scratch_path(spark, "logs-by-id")
    write_by_id(call_logs(spark, sf, previews=True), path)
    return X.log_detail(find_by_id(spark, path, "42"), "42")


register("log_detail_stored", O.log_detail_sql("42"))(_log_detail_stored)


def _json_lines(spark, sf):
    path = scratch_path(spark, "json-lines")
    events = payloads_from_events(read_table(spark, sf, "events"))
    events.select(F.col("payload").alias("value")).write.text(path)
    return MG.event_status_counts(ST.run_ingest_lines(spark, path, max_events=20000)[1])


register("stream_json_lines", O.event_status_counts_sql())(_json_lines)
register("pii_types_docs", O.pii_types_sql())(
    lambda spark, sf: R.redact_column(read_table(spark, sf, "documents").select("doc_id", F.expr(PLANTED_TEXT).alias("text")), "text", "text_redacted",
                                      with_detections=False).select("doc_id", "text_redacted", *[f"pii_{n}" for n in PII_TYPES]))
register("classify_url_forms", O.url_forms_sql())(
    lambda spark, sf: RP.classify_urls(read_table(spark, sf, "pages").select("page_id", F.expr(URL_FORMS).alias("url"))))
register("model_family_ids", O.model_ids_sql())(
    lambda spark, sf: RP.model_families(read_table(spark, sf, "events").select(F.expr(MODEL_IDS).alias("model"))))
