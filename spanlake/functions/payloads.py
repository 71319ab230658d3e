"""Heterogeneous provider payloads -> one schema (P23-P27), as JSON-path column expressions.

Request / response bodies of different providers are kept as JSON text; the
normaliser reads the fields it knows with ``get_json_object`` /
``from_json`` and falls through the known shapes in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import REQUEST_CONTENT_CHARS, RESPONSE_CONTENT_CHARS

MSG_ARRAY = "array<struct<role:string,content:string>>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _j(body, path: str) -> Column:
    return F.get_json_object(_c(body), path)


def _user(text: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"),
                            F.substring(text, 1, REQUEST_CONTENT_CHARS).alias("content")))


def request_messages(body) -> Column:
    """``messages`` | ``prompt`` | ``inputText`` | [] (content cut to 500)."""
    msgs = F.from_json(_j(body, "$.messages"), MSG_ARRAY)
    from_msgs = F.transform(msgs, lambda m: F.struct(
        F.coalesce(m["role"], F.lit("user")).alias("role"),
        F.substring(F.coalesce(m["content"], F.lit("")), 1, REQUEST_CONTENT_CHARS).alias("content")))
    prompt, input_text = _j(body, "$.prompt"), _j(body, "$.inputText")
    empty = F.array().cast(MSG_ARRAY)
    return (F.when(msgs.isNotNull(), from_msgs)
            .when(prompt.isNotNull(), _user(prompt))
            .when(input_text.isNotNull(), _user(input_text))
            .otherwise(empty))


def usage_tokens(resp) -> tuple[Column, Column]:
    """``usage.input/output_tokens``, else Titan counts, else NULLs."""
    usage = _j(resp, "$.usage")
    has_usage = usage.isNotNull() & (F.regexp_replace(usage, r"\s", "") != "{}")
    titan = _j(resp, "$.inputTextTokenCount").isNotNull()
    p = (F.when(has_usage, _j(resp, "$.usage.input_tokens"))
         .when(titan, _j(resp, "$.inputTextTokenCount")))
    c = (F.when(has_usage, _j(resp, "$.usage.output_tokens"))
         .when(titan, _j(resp, "$.results[0].tokenCount")))
    return p.try_cast("int"), c.try_cast("int")


def response_text(resp) -> Column:
    """P25: ``content[0].text`` | ``results[0].outputText`` | ``generation``, first non-empty, <= 2048."""
    t = F.coalesce(F.nullif(_j(resp, "$.content[0].text"), F.lit("")),
                   F.nullif(_j(resp, "$.results[0].outputText"), F.lit("")),
                   F.nullif(_j(resp, "$.generation"), F.lit("")), F.lit(""))
    return F.substring(t, 1, RESPONSE_CONTENT_CHARS)


# Usage field names per provider (prompt, completion).
USAGE_PATHS = {
    "anthropic": ("$.usage.input_tokens", "$.usage.output_tokens"),
    "google": ("$.usage_metadata.prompt_token_count", "$.usage_metadata.candidates_token_count"),
    "openai": ("$.usage.prompt_tokens", "$.usage.completion_tokens"),
}


def provider_usage(provider, resp) -> tuple[Column, Column]:
    """Usage by provider naming; Bedrock-style bodies fall back to P24."""
    p = F.lower(_c(provider))
    bp, bc = usage_tokens(resp)
    pt, ct = bp, bc
    for name, (pp, cp) in USAGE_PATHS.items():
        pt = F.when(p == name, _j(resp, pp).try_cast("int")).otherwise(pt)
        ct = F.when(p == name, _j(resp, cp).try_cast("int")).otherwise(ct)
    return pt, ct


def chat_and_system(messages) -> tuple[Column, Column]:
    """System messages split off; assistant -> model, everything else -> user."""
    m = _c(messages)
    system = F.array_join(F.transform(F.filter(m, lambda x: x["role"] == "system"), lambda x: x["content"]), "\n")
    chat = F.transform(F.filter(m, lambda x: x["role"] != "system"), lambda x: F.struct(
        F.when(x["role"] == "assistant", F.lit("model")).otherwise(F.lit("user")).alias("role"),
        x["content"].alias("content")))
    return chat, F.nullif(system, F.lit(""))
