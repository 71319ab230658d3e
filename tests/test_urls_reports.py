from spanlake.functions.urls import (bedrock_region, endpoint_key, model_family, provider_from_base_url,
                                     provider_from_url)
from spanlake.operators.reports import dedupe_keys


def test_provider_from_base_url(spark):
    df = spark.createDataFrame([("",), ("http://h:11434/v1",), ("https://x.openai.azure.com",),
                                ("http://10.0.0.1:8080",), ("https://api.openai.com/v1",), (None,)], "u string")
    got = [r[0] for r in df.select(provider_from_base_url("u")).collect()]
    assert got == ["openai", "ollama", "openai", "openai_compatible", "openai", "openai"]


def test_url_classes_and_keys(spark):
    rows = [("https://api.anthropic.com",), ("bedrock://eu-west-1",), ("bedrock:",),
            ("https://bedrock-runtime.us-west-2.amazonaws.com",), ("my.host.local:8000/",),
            ("https://generativelanguage.googleapis.com/v1",)]
    df = spark.createDataFrame(rows, "u string")
    p = provider_from_url("u")
    got = [tuple(r) for r in df.select(p, bedrock_region("u"), endpoint_key("u", p)).collect()]
    assert got == [("anthropic", "us-east-1", "anthropic"), ("bedrock", "eu-west-1", "bedrock"),
                   ("bedrock", "us-east-1", "bedrock"), ("bedrock", "us-west-2", "bedrock"),
                   ("openai_compatible", "us-east-1", "custom_my_host_local_8000"),
                   ("google", "us-east-1", "google")]


def test_model_family(spark):
    df = spark.createDataFrame([("anthropic.claude-3",), ("Meta.llama3",), ("gpt-4o",)], "m string")
    assert [r[0] for r in df.select(model_family("m")).collect()] == ["anthropic", "meta", "bedrock"]


def test_dedupe_keys_across_ranges(spark):
    rows = [(i, "k" if i % 3 else "j") for i in range(0, 40)]
    df = spark.createDataFrame(rows, "page_id long, endpoint_key string")
    got = {r["page_id"]: r["dedup_key"] for r in dedupe_keys(df, bucket_width=4).collect()}
    ks = [got[i] for i in range(40) if i % 3]
    assert ks[0] == "k" and ks[1:] == [f"k_{n}" for n in range(2, len(ks) + 1)]
    assert got[0] == "j" and got[3] == "j_2"


def test_dedupe_keys_keeps_null_keys_and_order_values(spark):
    rows = [("k", 1), ("k", None), ("k", 9), (None, 1), (None, None)]
    got = dedupe_keys(spark.createDataFrame(rows, "endpoint_key string, page_id long"), bucket_width=4).collect()
    assert sorted(((r.page_id, r.dedup_key) for r in got), key=str) == sorted([(None, "k"), (1, "k_2"), (9, "k_3"), (1, None), (None, None)], key=str)
