"""Declared schemas, enum domains and fixed parameters of the call-log model."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced)
# ---------------------------------------------------------------------------

# Trailing time ranges and the bucket width used for each one.
RANGE_INTERVAL = {"1h": _dt.timedelta(hours=1), "24h": _dt.timedelta(hours=24),
                  "7d": _dt.timedelta(days=7), "30d": _dt.timedelta(days=30)}
RANGE_BUCKET = {"1h": "5 minutes", "24h": "1 hour", "7d": "6 hours", "30d": "1 day"}

# Enum domains.
CONVERSATION_STATUS = ("ACTIVE", "CANCELLED", "COMPLETED", "ARCHIVED")
MESSAGE_ROLE = ("USER", "ASSISTANT", "SYSTEM")
INFERENCE_STATUS = ("SUCCESS", "ERROR", "CANCELLED", "TIMEOUT")
PROVIDER = ("OPENAI", "ANTHROPIC", "GOOGLE", "OTHER")
EVENT_STATUS = ("RECEIVED", "PROCESSED", "FAILED")

# Raw provider name -> stored provider enum; anything else becomes OTHER.
PROVIDER_ENUM_MAP = {"openai": "OPENAI", "anthropic": "ANTHROPIC", "google": "GOOGLE",
                     "ollama": "OTHER", "bedrock": "OTHER", "openai_compatible": "OTHER"}

# Column length bounds of the fact table.
LENGTH_BOUNDS = {"id": 36, "session_id": 255, "model": 100, "error_type": 100,
                 "sdk_version": 20, "environment": 20}
MIN_ID_LENGTH = 10

# Truncations.
PREVIEW_CHARS = 256
REQUEST_CONTENT_CHARS = 500
ERROR_MESSAGE_CHARS = 500
RESPONSE_CONTENT_CHARS = 2048
TITLE_CHARS = 60
DEFAULT_TITLE = "New conversation"
HISTORY_LIMIT = 20
SYSTEM_PROMPT = "You are a helpful assistant."
LOG_PAGE_MAX = 200
LIVE_FEED_SIZE = 50
TOP_MODELS = 10
CHARS_PER_TOKEN = 4

# Fixed clock of the test tables (all "now" reads become this parameter).
DEFAULT_AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0)

# ---------------------------------------------------------------------------
# Wire payload of one call event (unknown fields are dropped by from_json).
# ---------------------------------------------------------------------------

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("name", T.StringType()),
])

REQUEST = T.StructType([
    T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("prompt", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("max_tokens", T.IntegerType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])

RESPONSE = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("finish_reason", T.StringType()),
])

USAGE = T.StructType([
    T.StructField("prompt_tokens", T.IntegerType()),
    T.StructField("completion_tokens", T.IntegerType()),
    T.StructField("total_tokens", T.IntegerType()),
])

DETECTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("count", T.IntegerType()),
])

ERROR = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("code", T.StringType()),
])

# Timestamps and numbers arrive as JSON text; they are typed with try_cast in
# validation so that a bad value becomes a reject reason, not a lost row.
CALL_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("conversation_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("ended_at", T.StringType()),
    T.StructField("latency_ms", T.StringType()),
    T.StructField("ttft_ms", T.StringType()),
    T.StructField("streamed", T.BooleanType()),
    T.StructField("request", REQUEST),
    T.StructField("response", RESPONSE),
    T.StructField("usage", USAGE),
    T.StructField("cost_usd", T.DoubleType()),
    T.StructField("pii_detections", T.ArrayType(DETECTION)),
    T.StructField("error", ERROR),
    T.StructField("sdk_version", T.StringType()),
    T.StructField("environment", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

# Columns of the call fact table, in stored order.
FACT_COLUMNS = (
    "id", "conversation_id", "session_id", "provider", "provider_raw", "model", "status",
    "error_type", "error_message", "prompt_tokens", "completion_tokens", "total_tokens",
    "cost_usd", "latency_ms", "ttft_ms", "streamed", "input_preview", "output_preview",
    "input_hash", "request_payload", "response_payload", "pii_detections", "sdk_version",
    "environment", "started_at", "ended_at", "created_at", "metadata",
)

# Columns of the one-minute rollup table.
ROLLUP_COLUMNS = ("bucket", "provider", "model", "count_total", "count_error", "sum_latency_ms",
                  "count_ttft", "sum_ttft_ms", "sum_prompt_tokens", "sum_completion_tokens",
                  "sum_cost_usd")
