"""Views over the given tables in the shapes the call-log operators expect.

The reference keeps its facts in PostgreSQL; the test tables are generic
``events`` / ``documents`` / ``conversations``.  These functions derive, with
plain column expressions, a call fact table (``call_logs``), a chunk stream
(``chunk_events``), an at-least-once raw event log (``raw_events``) and a
message table (``conversation_messages``).  All are lazy: filters and column
selections of the caller reach the Parquet scans.  On a real deployment the fact
table is the Parquet output of the ingestion job (partitioned by date), and
these derivations are replaced by a scan of it.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cost import call_cost
from ..functions.normalize import total_tokens
from ..schemas import PREVIEW_CHARS
from .tables import read_table


# Column derivations of the call fact view, as SQL expressions (one plan call each).
_LOG_EXPRS = (
    "CAST(event_id AS STRING) AS id",
    "ts AS created_at",
    "user_id AS conversation_id",
    "CASE event_id % 4 WHEN 0 THEN 'OPENAI' WHEN 1 THEN 'ANTHROPIC' WHEN 2 THEN 'GOOGLE' ELSE 'OTHER' END AS provider",
    "CASE event_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'google' ELSE 'ollama' END"
    " AS provider_raw",
    "CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 8 = 0 THEN 'gpt-4o-mini' ELSE 'gpt-4o' END"
    " WHEN 1 THEN 'claude-3-5-haiku-latest' WHEN 2 THEN 'gemini-1.5-flash'"
    " ELSE CASE WHEN event_id % 8 = 3 THEN 'gemma3:4b' ELSE 'llama3.2:latest' END END AS model",
    "CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'CANCELLED'"
    " ELSE 'SUCCESS' END AS status",
    "CASE WHEN event_type = 'error' THEN CASE event_id % 6 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'context_length'"
    " WHEN 2 THEN 'timeout' END END AS error_type",
    "CASE WHEN event_type = 'error' THEN props END AS error_message",
    "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(50 + (event_id * 37) % 1951 AS INT) END AS prompt_tokens",
    "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(20 + (event_id * 53) % 781 AS INT) END AS completion_tokens",
    "CAST(FLOOR(value * 20) + 50 AS INT) AS latency_ms",
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(80 + (event_id * 11) % 421 AS INT) END AS ttft_ms",
    "event_id % 5 > 1 AS streamed",
    "'dev' AS environment",
    "event_id",
)


def logs_from_events(events: DataFrame) -> DataFrame:
    """Call fact rows from the ``events`` table (works on batch and streaming frames)."""
    base = events.selectExpr(*_LOG_EXPRS)
    return base.select(
        "*",
        total_tokens("prompt_tokens", "completion_tokens").alias("total_tokens"),
        call_cost("provider_raw", "model", "prompt_tokens", "completion_tokens").alias("cost_usd"),
        F.col("created_at").alias("ended_at"),
        F.expr("created_at - make_dt_interval(0, 0, 0, CAST(latency_ms / 1000 AS DECIMAL(18, 6)))")
         .alias("started_at"))


def document_previews(documents: DataFrame) -> DataFrame:
    """Per document: the input is its text, the output what follows the first 256 code points; previews are the first
    256 of each.

    Lists read the two short strings only; whole texts travel where payloads are asked for.
    """
    return documents.select(
        F.col("doc_id").alias("preview_doc_id"),
        F.nullif(F.substring("text", 1, PREVIEW_CHARS), F.lit("")).alias("input_preview"),
        F.nullif(F.substring("text", PREVIEW_CHARS + 1, PREVIEW_CHARS), F.lit("")).alias("output_preview"),
        F.col("text").alias("whole_text"),
    )


def call_logs(spark: SparkSession, sf_dir: str, previews: bool = False) -> DataFrame:
    """The call fact table.  ``previews`` adds input/output previews (doc_id = event_id)."""
    logs = logs_from_events(read_table(spark, sf_dir, "events"))
    if previews:
        pv = document_previews(read_table(spark, sf_dir, "documents"))
        logs = (logs.join(pv, logs["event_id"] == pv["preview_doc_id"], "left")
                .drop("preview_doc_id"))
        msg = F.struct(F.lit("user").alias("role"),
                       F.coalesce(F.col("whole_text"), F.lit("")).alias("content"))
        logs = (logs
                .withColumn("request_payload", F.to_json(F.struct(F.array(msg).alias("messages"))))
                .withColumn("response_payload", F.to_json(F.struct(
                    F.coalesce(F.substr("whole_text", F.lit(PREVIEW_CHARS + 1)), F.lit("")).alias("content"),
                    F.lit("stop").alias("finish_reason"))))
                .withColumn("pii_detections", F.lit("[]")).drop("whole_text"))
    return logs


def with_previews(spark: SparkSession, sf_dir: str, page: DataFrame) -> DataFrame:
    """A page's rows with their previews; the documents are cut to the page's ids (a page is a bounded number of rows)
    before anything else is done with them."""
    ids = page.select(F.col("event_id").alias("doc_id"))
    hit = document_previews(read_table(spark, sf_dir, "documents").join(F.broadcast(ids), "doc_id", "left_semi")).drop("whole_text")
    return page.join(hit, page["event_id"] == hit["preview_doc_id"], "left").drop("preview_doc_id")


def chunk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed chunks: one span per user; ``view`` events carry empty deltas."""
    return chunks_from_events(read_table(spark, sf_dir, "events"))


def chunks_from_events(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    return events.select(
        F.col("user_id").cast("string").alias("span_id"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.when(et == "view", F.lit("")).otherwise(F.substring(et, 1, 2)).alias("delta"),
        F.when(et == "signup", (F.col("event_id") % 500).cast("int")).alias("prompt_tokens"),
        F.when(et == "purchase", (F.col("event_id") % 300).cast("int")).alias("completion_tokens"),
        (et == "error").alias("is_error"),
    )


def ended_chunks(events: DataFrame) -> DataFrame:
    """Chunks of short spans (a user's five days) that end by error, by cancelling, in order or not at all."""
    et, eid = F.col("event_type"), F.col("event_id")
    kind = F.when(et == "error", "error").when((et == "signup") & (eid % 2 == 0), "end").when(et == "signup", "cancelled").otherwise("chunk")
    span = F.concat(F.lit("span-"), F.lpad(F.col("user_id").cast("string"), 8, "0"), F.lit("-"),
                    F.floor(F.unix_date(F.to_date("ts")) / 5).cast("string"))
    return events.select(span.alias("span_id"), eid.alias("seq"), "ts",
                         F.when(et == "view", F.lit("")).otherwise(F.substring(et, 1, 2)).alias("delta"),
                         F.when(et != "error", (eid % 500).cast("int")).alias("prompt_tokens"),
                         F.when(et == "purchase", (eid % 300).cast("int")).alias("completion_tokens"),
                         kind.alias("kind"), F.when(et == "error", F.lit("upstream_error")).alias("error_type"),
                         F.when(et == "error", F.col("props")).alias("error_message"))


def span_context(chunks: DataFrame) -> DataFrame:
    """What a span was started with: model, a long request that names an address, conversation."""
    user = F.substring("span_id", 6, 8)
    text = F.concat(F.lit("mail user"), user, F.lit("@example.com "), F.repeat(F.lit("x"), F.lit(600)))
    message = F.struct(F.lit("user").alias("role"), text.alias("content"), F.lit(None).cast("string").alias("name"))
    request = F.struct(F.array(message).alias("messages"), F.lit(None).cast("string").alias("prompt"), F.lit(None).cast("double").alias("temperature"),
                       F.lit(None).cast("int").alias("max_tokens"), F.lit(None).cast("map<string,string>").alias("extra"))
    return chunks.select("span_id").distinct().select(
        "span_id", F.lit("openai").alias("provider"), F.lit("gpt-4o-mini").alias("model"), request.alias("request"),
        user.alias("conversation_id"), F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("map<string,string>").alias("metadata"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At-least-once raw event log with repeated ids and bad rows."""
    return raw_from_events(read_table(spark, sf_dir, "events"))


def raw_from_events(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    et = F.col("event_type")
    return events.select(
        eid.alias("event_id"),
        F.col("ts").alias("received_at"),
        F.when(eid % 7 == 0, eid - eid % 14).otherwise(eid).alias("id"),
        F.when(et == "error", F.lit("error")).when(et == "view", F.lit("bogus"))
         .otherwise(F.lit("success")).alias("status"),
        (F.floor(F.col("value") * 20).cast("int") - 40).alias("latency_ms"),
        F.when(eid % 17 != 0, (eid % 1951).cast("int")).alias("prompt_tokens"),
    )


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message table: (conversation_id, turn, role, content); ``turn`` orders messages."""
    return read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.col("turn"),
        F.upper("role").alias("role"), F.col("text").alias("content"))


def as_of_literal(value: _dt.datetime | str | None = None) -> Column:
    """A TIMESTAMP_NTZ literal (the test tables store timestamp_ntz)."""
    from ..schemas import DEFAULT_AS_OF
    v = value or DEFAULT_AS_OF
    if isinstance(v, _dt.datetime):
        v = v.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(v).cast("timestamp_ntz")


def provider_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw provider request/response JSON bodies in five shapes, one per event type."""
    ev = read_table(spark, sf_dir, "events")
    return ev.selectExpr(
        "event_id",
        "CASE event_type WHEN 'click' THEN 'anthropic' WHEN 'view' THEN 'bedrock' WHEN 'purchase' THEN 'bedrock'"
        " WHEN 'signup' THEN 'openai' ELSE 'google' END AS provider",
        "CASE event_type WHEN 'click' THEN 'claude-3-5-haiku-latest' WHEN 'view' THEN 'amazon.titan-text-express-v1'"
        " WHEN 'purchase' THEN 'meta.llama3-8b-instruct-v1:0' WHEN 'signup' THEN 'gpt-4o'"
        " ELSE 'gemini-1.5-flash' END AS model",
        """CASE event_type
             WHEN 'click' THEN to_json(named_struct('messages', array(named_struct('role', 'user', 'content', props))))
             WHEN 'view' THEN to_json(named_struct('inputText', props))
             WHEN 'purchase' THEN to_json(named_struct('prompt', props))
             WHEN 'signup' THEN to_json(named_struct('messages', array(named_struct('role', 'system', 'content', 'be brief'),
                                                                       named_struct('role', 'user', 'content', props))))
             ELSE to_json(named_struct('messages', array(named_struct('role', 'assistant', 'content', 'earlier'),
                                                          named_struct('role', 'user', 'content', props))))
           END AS request_body""",
        """CASE event_type
             WHEN 'click' THEN to_json(named_struct('content', array(named_struct('type', 'text', 'text',
                 concat('c', CAST(event_id AS STRING)))), 'usage', named_struct('input_tokens', event_id % 500,
                 'output_tokens', event_id % 300)))
             WHEN 'view' THEN to_json(named_struct('inputTextTokenCount', event_id % 100, 'results',
                 array(named_struct('tokenCount', event_id % 50, 'outputText', concat('v', CAST(event_id AS STRING))))))
             WHEN 'purchase' THEN to_json(named_struct('generation', concat('p', CAST(event_id AS STRING))))
             WHEN 'signup' THEN to_json(named_struct('usage', named_struct('prompt_tokens', event_id % 700,
                 'completion_tokens', event_id % 90)))
             ELSE to_json(named_struct('usage_metadata', named_struct('prompt_token_count', event_id % 800,
                 'candidates_token_count', event_id % 70)))
           END AS response_body""")


# --- rows that reach every PII type, URL form and model family ---------------------------------------
# SQL expressions that Spark and DuckDB read alike, over the columns of the given tables.

_MD5 = "md5(CAST(doc_id AS STRING))"
PLANTED_TEXT = f"""CASE doc_id % 9
 WHEN 0 THEN 'ssn ' || CAST(100 + doc_id % 900 AS STRING) || '-' || CAST(10 + doc_id % 90 AS STRING) || '-' || CAST(1000 + doc_id % 9000 AS STRING) || ' of '
 WHEN 1 THEN 'card 4111 1111 1111 1111, not 4111 1111 1111 1112: '
 WHEN 2 THEN 'key AKIA' || substr(upper({_MD5}), 1, 16) || ' and '
 WHEN 3 THEN 'key sk-' || substr({_MD5}, 1, 24) || ' and AKIA' || substr({_MD5}, 1, 5) || ' '
 WHEN 4 THEN 'key AIza' || {_MD5} || 'x-_ for '
 WHEN 5 THEN 'see https://host.example/?a=1&token=' || substr({_MD5}, 1, 12) || '&b=2 password=' || substr({_MD5}, 5, 8) || ' '
 WHEN 6 THEN 'ssn 123 45 6789 from 10.0.' || CAST(doc_id % 300 AS STRING) || '.7 '
 WHEN 7 THEN 'card 5500-0000-0000-0004 of user' || CAST(doc_id AS STRING) || '@mail.example.org '
 ELSE '' END || COALESCE(text, '')"""

URL_FORMS = """CASE page_id % 16
 WHEN 0 THEN 'https://api.openai.com/v1/' || CAST(page_id AS STRING)
 WHEN 1 THEN 'https://api.anthropic.com'
 WHEN 2 THEN ' generativelanguage.googleapis.com/v1beta/ '
 WHEN 3 THEN 'https://r' || CAST(page_id AS STRING) || '.openai.azure.com/'
 WHEN 4 THEN 'bedrock://eu-west-' || CAST(page_id % 3 + 1 AS STRING)
 WHEN 5 THEN 'bedrock:ap-south-1/'
 WHEN 6 THEN 'bedrock://'
 WHEN 7 THEN 'https://bedrock-runtime.us-west-2.amazonaws.com/model'
 WHEN 8 THEN 'https://bedrock.eu-central-1.api.aws'
 WHEN 9 THEN 'https://vpce-0a.bedrock-runtime.sa-east-1.vpce.amazonaws.com'
 WHEN 10 THEN 'http://localhost:11434/'
 WHEN 11 THEN 'http://Ollama.internal:8080/v1'
 WHEN 12 THEN 'user:pw@LLM' || CAST(page_id % 5 AS STRING) || '.example.com:9000//'
 WHEN 13 THEN ''
 WHEN 14 THEN NULL
 ELSE url END"""

MODEL_IDS = """CASE event_id % 8 WHEN 0 THEN 'anthropic.claude-3' WHEN 1 THEN 'Amazon.titan' WHEN 2 THEN 'meta.llama3' WHEN 3 THEN 'mistral.large'
 WHEN 4 THEN 'cohere.command' WHEN 5 THEN 'ai21.jamba' WHEN 6 THEN 'metallic' ELSE NULL END"""
