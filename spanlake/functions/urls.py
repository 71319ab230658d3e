"""Endpoint URL and model-id classification as column expressions (P18-P22), re-aimed
from per-call helpers to columns over a table of URLs / model ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Host substring -> provider, checked in this order.
URL_PROVIDER_MAP = (
    ("api.openai.com", "openai"),
    ("api.anthropic.com", "anthropic"),
    ("generativelanguage.googleapis.com", "google"),
    ("openai.azure.com", "openai"),
)
# Bedrock model-id prefix -> model family, checked in this order; default "bedrock".
MODEL_FAMILY_PREFIXES = (
    ("anthropic.", "anthropic"),
    ("amazon.", "amazon"),
    ("meta.", "meta"),
    ("mistral.", "mistral"),
    ("cohere.", "cohere"),
    ("ai21.", "ai21"),
)
BEDROCK_REGION_PATTERNS = (
    r"bedrock(?:-runtime|-agent-runtime)?\.([a-z0-9-]+)\.vpce\.amazonaws\.com",
    r"bedrock(?:-runtime|-agent-runtime)?\.([a-z0-9-]+)\.amazonaws\.com",
    r"bedrock(?:-runtime|-agent-runtime)?\.([a-z0-9-]+)\.api\.aws",
)
DEFAULT_REGION = "us-east-1"
LOCAL_PORT = "11434"
NAMED_KEY_PROVIDERS = ("openai", "anthropic", "google", "bedrock", "ollama")
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def provider_from_base_url(url) -> Column:
    """Client base URL -> openai / ollama / openai_compatible (order matters)."""
    u = _c(url)
    return (F.when(u.isNull() | (u == "") | u.contains("api.openai.com"), F.lit("openai"))
            .when(u.contains(LOCAL_PORT) | F.lower(u).contains("ollama"), F.lit("ollama"))
            .when(u.contains("openai.azure.com"), F.lit("openai"))
            .otherwise(F.lit("openai_compatible")))


def normalize_url(url) -> Column:
    """strip, drop trailing '/', add http:// when no scheme (bedrock: forms kept)."""
    u = F.regexp_replace(F.trim(_c(url)), r"/+$", "")
    lu = F.lower(u)
    keep = lu.startswith("bedrock://") | lu.startswith("bedrock:") | u.startswith("http://") | u.startswith("https://")
    return F.when(keep, u).otherwise(F.concat(F.lit("http://"), u))


def is_bedrock_url(url) -> Column:
    """Bedrock scheme, or 'bedrock' with an AWS host."""
    u = F.lower(F.trim(_c(url)))
    return (u.startswith("bedrock://") | u.startswith("bedrock:") |
            (u.contains("bedrock") & (u.contains("amazonaws.com") | u.contains(".api.aws"))))


def provider_from_url(url) -> Column:
    """Bedrock test, then known hosts in order, else openai_compatible (no probing)."""
    u = normalize_url(url)
    expr = F.lit("openai_compatible")
    for pattern, provider in reversed(URL_PROVIDER_MAP):
        expr = F.when(u.contains(pattern), F.lit(provider)).otherwise(expr)
    return F.when(is_bedrock_url(u), F.lit("bedrock")).otherwise(expr)


def bedrock_region(url, default_region: str = DEFAULT_REGION) -> Column:
    """P20: region from bedrock://region, bedrock:region or a bedrock AWS host."""
    u = F.trim(_c(url))
    lu = F.lower(u)

    def after(prefix_len: int) -> Column:
        rest = F.regexp_replace(F.regexp_replace(F.substring(u, prefix_len + 1, 1 << 20), r"^/+", ""), r"/+$", "")
        return F.nullif(F.split(rest, "/")[0], F.lit(""))

    from_host = F.lit(None).cast("string")
    for pat in reversed(BEDROCK_REGION_PATTERNS):
        from_host = F.coalesce(F.nullif(F.regexp_extract(lu, pat, 1), F.lit("")), from_host)
    return (F.when(lu.startswith("bedrock://"), F.coalesce(after(10), F.lit(default_region)))
            .when(lu.startswith("bedrock:"), F.coalesce(after(8), F.lit(default_region)))
            .otherwise(F.coalesce(from_host, F.lit(default_region))))


def url_host(url) -> Column:
    """Host part (lower-cased, without user info and port) of a normalised URL."""
    netloc = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    no_user = F.regexp_replace(netloc, r"^.*@", "")
    return F.nullif(F.lower(F.regexp_replace(no_user, r":[0-9]*$", "")), F.lit(""))


def url_port(url) -> Column:
    netloc = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    p = F.regexp_extract(netloc, r":([0-9]+)$", 1)
    return F.when(p != "", p.cast("long"))


def endpoint_key(url, provider) -> Column:
    """Named providers keep their name; others custom_<host with _>[_<port>]."""
    u = normalize_url(url)
    host = F.regexp_replace(F.coalesce(url_host(u), F.lit("endpoint")), r"\.", "_")
    port = url_port(u)
    custom = F.concat(F.lit("custom_"), host,
                      F.when(port.isNotNull() & (port != 0), F.concat(F.lit("_"), port.cast("string")))
                      .otherwise(F.lit("")))
    return F.when(_c(provider).isin(*NAMED_KEY_PROVIDERS), _c(provider)).otherwise(custom)


def model_family(model_id) -> Column:
    """Model-id prefix -> family; default bedrock."""
    m = F.lower(_c(model_id))
    expr = F.lit("bedrock")
    for prefix, fam in reversed(MODEL_FAMILY_PREFIXES):
        expr = F.when(m.startswith(prefix), F.lit(fam)).otherwise(expr)
    return expr
