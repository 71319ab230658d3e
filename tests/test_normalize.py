from decimal import Decimal

from pyspark.sql import functions as F

from spanlake.functions.cost import call_cost
from spanlake.functions.normalize import (estimate_tokens, half_even_ratio, input_preview, output_preview,
                                          provider_enum, status_upper, total_tokens)
from spanlake.schemas import MESSAGE


def test_total_tokens_edge_cases(spark):
    df = spark.createDataFrame([(0, 0), (0, None), (5, None), (None, None), (3, 4)], "p int, c int")
    got = [r[0] for r in df.select(total_tokens("p", "c")).collect()]
    assert got == [None, None, 5, None, 7]


def test_input_preview(spark):
    schema = f"messages array<{MESSAGE.simpleString()}>, prompt string"
    rows = [([("user", "", None), ("user", "", None)], None),
            (None, "p"), ([], None), ([("user", "x" * 300, None)], None), (None, None)]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(input_preview("messages", "prompt")).collect()]
    assert got == [" ", "p", None, "x" * 256, None]


def test_output_preview(spark):
    df = spark.createDataFrame([("",), (None,), ("y" * 300,)], "c string")
    assert [r[0] for r in df.select(output_preview("c")).collect()] == [None, None, "y" * 256]


def test_provider_and_status(spark):
    df = spark.createDataFrame([("OpenAI", None), ("ollama", "error"), ("bedrock", "Success"), (None, None),
                                ("weird", "cancelled")], "p string, s string")
    got = [(r[0], r[1]) for r in df.select(provider_enum("p"), status_upper("s")).collect()]
    assert got == [("OPENAI", "SUCCESS"), ("OTHER", "ERROR"), ("OTHER", "SUCCESS"), ("OTHER", "SUCCESS"),
                   ("OTHER", "CANCELLED")]


def test_token_estimate(spark):
    df = spark.createDataFrame([(None,), ("",), ("abc",), ("a" * 9,)], "t string")
    assert [r[0] for r in df.select(estimate_tokens("t")).collect()] == [0, 0, 1, 2]


def test_cost_lookup(spark):
    rows = [("openai", "gpt-4o", 1000, 1000), ("openai", "unknown-model", 10, 10), ("openai", "gpt-4o", None, 5),
            ("ollama", "llama3.2:latest", 1_000_000, 0), ("ollama", "mystery:7b", 1_000_000, 1_000_000),
            ("ollama", "gemma3:1b", 1_000_000, 0), ("OpenAI", "GPT-4o-MINI", 1_000_000, 0)]
    df = spark.createDataFrame(rows, "p string, m string, a int, b int")
    got = [r[0] for r in df.select(call_cost("p", "m", "a", "b")).collect()]
    assert got == [Decimal("0.012500"), None, None, Decimal("0.080000"), Decimal("0.160000"),
                   Decimal("0.020000"), Decimal("0.150000")]


def test_error_rate_half_even(spark):
    df = spark.createDataFrame([(0, 0), (1, 32), (3, 32), (1, 3), (2, 3)], "e long, t long")
    got = [r[0] for r in df.select(half_even_ratio(F.col("e"), F.col("t"), 4)).collect()]
    assert got == [0.0, 0.0312, 0.0938, 0.3333, 0.6667]
