"""Column expressions that normalise one call record.

Every function returns a ``Column``; nothing here touches Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import (CHARS_PER_TOKEN, ERROR_MESSAGE_CHARS, PREVIEW_CHARS, PROVIDER_ENUM_MAP,
                       REQUEST_CONTENT_CHARS, RESPONSE_CONTENT_CHARS)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def provider_enum(provider_raw) -> Column:
    """Lower-cased raw provider -> enum; unknown / missing -> OTHER."""
    p = F.lower(F.coalesce(_c(provider_raw), F.lit("other")))
    expr = F.lit("OTHER")
    for raw, enum in reversed(list(PROVIDER_ENUM_MAP.items())):
        expr = F.when(p == raw, F.lit(enum)).otherwise(expr)
    return expr


def provider_raw(provider) -> Column:
    """Raw provider as stored beside the enum (needed to re-price later)."""
    return F.lower(F.coalesce(_c(provider), F.lit("other")))


def status_upper(status) -> Column:
    """Status is lower-cased at ingest and upper-cased at store; default success."""
    return F.upper(F.coalesce(_c(status), F.lit("success")))


def total_tokens(prompt, completion) -> Column:
    """Sum with NULL->0 when either count is non-zero; else NULL ((0,0) -> NULL)."""
    p, c = F.coalesce(_c(prompt), F.lit(0)), F.coalesce(_c(completion), F.lit(0))
    return F.when((p != 0) | (c != 0), p + c)


def input_preview(messages, prompt) -> Column:
    """Contents joined by one space, else prompt; first 256 code points; '' -> NULL."""
    joined = F.array_join(F.transform(_c(messages), lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    text = F.coalesce(F.nullif(joined, F.lit("")), _c(prompt))
    return F.nullif(F.substring(text, 1, PREVIEW_CHARS), F.lit(""))


def output_preview(content) -> Column:
    """P5: first 256 code points of the response content; '' -> NULL."""
    return F.nullif(F.substring(F.coalesce(_c(content), F.lit("")), 1, PREVIEW_CHARS), F.lit(""))


def input_hash(request) -> Column:
    """SHA-256 of a canonical JSON form of the request: its fields in the schema's order, and the
    free-form ``extra`` entries in key order whatever order they came in."""
    r = _c(request)
    extra = F.map_from_entries(F.array_sort(F.map_entries(r["extra"])))
    return F.sha2(F.to_json(F.when(r.isNotNull(), r.withField("extra", extra))), 256)


def truncate_request(messages) -> Column:
    """Request message contents are cut to 500 code points."""
    return F.transform(_c(messages), lambda m: m.withField(
        "content", F.substring(m["content"], 1, REQUEST_CONTENT_CHARS)))


def truncate_error_message(msg) -> Column:
    return F.substring(_c(msg), 1, ERROR_MESSAGE_CHARS)


def truncate_response(content) -> Column:
    return F.substring(_c(content), 1, RESPONSE_CONTENT_CHARS)


def estimate_tokens(text) -> Column:
    """0 for NULL / empty text, else max(1, floor(chars / 4))."""
    n = F.coalesce(F.length(_c(text)), F.lit(0))
    return F.when(n == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.floor(n / CHARS_PER_TOKEN).cast("int")))


def half_even_ratio(num, den, digits: int = 4) -> Column:
    """num/den rounded half-to-even at ``digits`` decimals, computed on integers.

    Exact on the rational value, so both engines in the oracle check agree; 0
    when den is 0 (G7: empty range -> 0).
    """
    scale = 10 ** digits
    n, d = _c(num).cast("long") * scale, _c(den).cast("long")
    r = n % d
    # (n - r) is a multiple of d: the decimal quotient is exact at any size.
    q = ((n - r).cast("decimal(38,0)") / d.cast("decimal(38,0)")).cast("long")
    up = (2 * r > d) | ((2 * r == d) & (q % 2 == 1))
    return F.when(d > 0, (q + F.when(up, 1).otherwise(0)) / F.lit(float(scale))).otherwise(F.lit(0.0))


def trunc_to_long(x) -> Column:
    """Python ``int(v or 0)``: NULL -> 0, truncate toward zero.

    Percentiles are rounded to 6 decimals first so that engines that
    interpolate in a different order agree.
    """
    v = F.round(F.coalesce(_c(x).cast("double"), F.lit(0.0)), 6)
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("long")
