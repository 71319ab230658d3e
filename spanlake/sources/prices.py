"""Price catalog source.

Rates are exact decimals per token (``DECIMAL(12,9)``): a double rate would make
the stored ``DECIMAL(12,6)`` cost depend on float rounding.  The catalog is a
fixed, small constant, so the default lookup is a map literal evaluated inside
the projection (no join, no exchange).  A user catalog can be passed as a
DataFrame, whose join is left to the planner (see operators.cost).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# USD per one million tokens, (input, output).
# ---------------------------------------------------------------------------
CLOUD_PRICES_PER_MILLION = {
    "openai:gpt-4o-mini": ("0.15", "0.60"),
    "openai:gpt-4.1-mini": ("0.40", "1.60"),
    "openai:gpt-4o": ("2.50", "10.00"),
    "openai:gpt-4.1": ("2.00", "8.00"),
    "anthropic:claude-3-5-haiku-latest": ("0.80", "4.00"),
    "anthropic:claude-3-5-sonnet-latest": ("3.00", "15.00"),
    "anthropic:claude-sonnet-4-5": ("3.00", "15.00"),
    "google:gemini-1.5-flash": ("0.075", "0.30"),
    "google:gemini-1.5-pro": ("1.25", "5.00"),
    "google:gemini-2.0-flash": ("0.10", "0.40"),
    "bedrock:anthropic.claude-3-5-sonnet-20241022-v2:0": ("3.00", "15.00"),
    "bedrock:anthropic.claude-3-5-haiku-20241022-v1:0": ("0.80", "4.00"),
    "bedrock:anthropic.claude-3-haiku-20240307-v1:0": ("0.25", "1.25"),
    "bedrock:anthropic.claude-3-sonnet-20240229-v1:0": ("3.00", "15.00"),
    "bedrock:amazon.titan-text-express-v1": ("0.20", "0.60"),
    "bedrock:amazon.titan-text-lite-v1": ("0.15", "0.20"),
    "bedrock:amazon.titan-text-premier-v1:0": ("0.50", "1.50"),
    "bedrock:meta.llama3-8b-instruct-v1:0": ("0.22", "0.22"),
    "bedrock:meta.llama3-70b-instruct-v1:0": ("0.99", "0.99"),
    "bedrock:meta.llama3-1-8b-instruct-v1:0": ("0.22", "0.22"),
    "bedrock:meta.llama3-1-70b-instruct-v1:0": ("0.72", "0.72"),
    "bedrock:mistral.mistral-7b-instruct-v0:2": ("0.15", "0.20"),
    "bedrock:mistral.mixtral-8x7b-instruct-v0:1": ("0.45", "0.70"),
}

LOCAL_PRICES_PER_MILLION = {
    "gemma3:1b": ("0.02", "0.02"),
    "llama3.2:1b": ("0.02", "0.02"),
    "phi3:mini": ("0.02", "0.02"),
    "gemma2:2b": ("0.02", "0.02"),
    "deepseek-r1:1.5b": ("0.02", "0.02"),
    "gemma3:4b": ("0.08", "0.08"),
    "gemma2:9b": ("0.08", "0.08"),
    "llama3.2": ("0.08", "0.08"),
    "llama3.1:8b": ("0.08", "0.08"),
    "mistral": ("0.08", "0.08"),
    "mistral:7b": ("0.08", "0.08"),
    "phi3": ("0.08", "0.08"),
    "qwen2.5:7b": ("0.08", "0.08"),
    "deepseek-r1:7b": ("0.08", "0.08"),
    "codellama:7b": ("0.08", "0.08"),
    "codellama": ("0.08", "0.08"),
    "gemma3:12b": ("0.20", "0.20"),
    "llama3.1": ("0.20", "0.20"),
    "mistral-nemo": ("0.20", "0.20"),
    "qwen2.5": ("0.20", "0.20"),
}

LOCAL_DEFAULT_PER_MILLION = ("0.08", "0.08")
LOCAL_PROVIDER = "ollama"
LOCAL_TAG = ":latest"
# ---------------------------------------------------------------------------

RATE_TYPE = T.DecimalType(12, 9)
COST_TYPE = T.DecimalType(12, 6)

PRICE_SCHEMA = T.StructType([
    T.StructField("price_key", T.StringType(), False),
    T.StructField("local", T.BooleanType(), False),
    T.StructField("input_rate", RATE_TYPE, False),
    T.StructField("output_rate", RATE_TYPE, False),
])


def per_token(per_million: str) -> Decimal:
    return (Decimal(per_million) / Decimal(1_000_000)).quantize(Decimal("0.000000001"))


def price_rows() -> list[tuple[str, bool, Decimal, Decimal]]:
    rows = [(k, False, per_token(i), per_token(o)) for k, (i, o) in CLOUD_PRICES_PER_MILLION.items()]
    rows += [(k, True, per_token(i), per_token(o)) for k, (i, o) in LOCAL_PRICES_PER_MILLION.items()]
    return rows


def price_catalog(spark: SparkSession, rows=None) -> DataFrame:
    """The catalog as a (small, local) DataFrame; editable by passing rows."""
    return spark.createDataFrame(rows if rows is not None else price_rows(), PRICE_SCHEMA)
