"""URL filters: explicit rules, and block decisions carried to aliases over redirects and canonical links.

Method.  A rule is a host suffix with a path prefix; the longest that fits a URL decides it.  URLs that no rule
fits take their decision from their aliases: nodes are canonical URL keys (scheme, ``www.``/``m.`` label, fragment,
tracking parameters, a final slash or ``.html`` removed), edges come from pages to the targets of all ``rel=canonical`` links and
refresh redirects in their html, relative ones read on the page's URL, and connected components join whatever leads to one another.  A component
with an explicitly allowed URL is allowed (allow precedence), else one with a blocked URL is blocked, else allowed.

Scale.  Columns only, no Python.  Distinct URLs and edges shuffle, html does not leave the scan.  Rules match by
a lookup of the host's suffixes, so a hot host needs no grouping.  Components run in distributed star rounds over
keys that have an edge to another key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import components, save

# (action, host suffix, path prefix), from the contract
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRACKING = r"(?i)^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
REL = r"(?is)\srel\s*=\s*(?:[\"'][^\"'>]*\bcanonical\b|canonical\b)"
HREF = r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)\shttp-equiv\s*=\s*[\"']?refresh\b"
HOP = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"
SCHEME = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):"


def _ascii_lower(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url):
    """``(host, path)`` columns: both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return _ascii_lower(host), path


def url_key(url):
    """The canonical key of a URL; null for null or without ``://``."""
    host, path = split_url(url)
    query = F.regexp_extract(F.split(url, "#", 2)[0], r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    bare = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", "")
    key = F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), bare, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, key)


def longest_rule(host, path, rules=RULES):
    """A struct ``(action, rule)`` of the longest fitting rule, null fields without one.  Ties: allow before block."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))
    out = F.struct(F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("rule"))
    for action, suffix, prefix in reversed(order):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(suffix + prefix).alias("rule"))).otherwise(out)
    return out


def resolve(target, base):
    """``target`` as an absolute URL, read on the page ``base``: absolute, ``//host``, ``/path``, ``?query`` or relative
    with ``.`` and ``..``; null for a mere fragment and for schemes without ``//``."""
    scheme = F.substring_index(base, "://", 1)
    rest = F.substring(base, F.instr(base, "://") + F.lit(3), F.length(base))
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    own, tail = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), F.lit("/"), own))
    flat = F.aggregate(F.split(F.regexp_replace(whole, "^/", ""), "/"), F.lit(""), lambda done, x: F.when(x == ".", done).when(
        x == "..", F.regexp_replace(done, r"/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x)))
    return (F.when(target.startswith("#"), F.lit(None)).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(F.regexp_extract(target, SCHEME, 1) != "", F.when(F.instr(target, "://") > 0, target))
            .when(target.startswith("?"), F.concat(root, path, target)).otherwise(F.concat(root, flat, tail)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(a, b)``: distinct pairs of different URL keys joined by a redirect or a canonical link.

    Every ``link`` and ``meta`` element counts, with its attributes in any order."""
    # only documents with such an element are searched
    has = F.lower("html").contains("canonical") | F.lower("html").contains("refresh")
    tags = (pages.where(has & (F.instr("url", "://") > 0)).select("url", F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("tag")))
    to = (F.when(F.col("tag").rlike(REL), F.regexp_extract("tag", HREF, 1))
          .when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", HOP, 1)))
    found = tags.withColumn("to", to).where("to <> ''").select(
        url_key(F.col("url")).alias("a"), resolve(F.col("to"), F.col("url")).alias("to"))
    return (found.select("a", url_key(F.col("to")).alias("b"))
            .where("b is not null and a <> b").distinct())


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per input row.

    A null URL or one without ``://`` has empty host and path, fits no rule and has no aliases: allowed.  Empty
    and null html give no edges; repeated rows stay; an empty table gives an
    empty result; other columns are not read.
    """
    own_host, own_path = split_url(F.col("url"))
    base = pages.select("page_id", own_host.alias("host"), own_path.alias("path"), url_key(F.col("url")).alias("key"))
    base = base.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", "key", F.col("hit.rule").alias("rule"), F.col("hit.action").alias("action"))
    base = save(base, "url-pages")
    edges = save(alias_edges(pages.select("url", "html")), "url-edges")
    comp = components(edges, "url-links").select(F.col("node").alias("key"), "component") if edges.take(1) else None
    # decisions per key, then per component; a key without edges is a component of its own
    keys = base.where("key is not null").groupBy("key").agg(
        F.max(F.col("action") == "allow").alias("allow"), F.max(F.col("action") == "block").alias("block"))
    keys = keys.join(comp, "key", "left") if comp is not None else keys.withColumn("component", F.lit(None).cast("string"))
    keys = save(keys.withColumn("component", F.coalesce("component", "key")), "url-keys")
    blocked = (keys.groupBy("component").agg(F.coalesce(F.max("allow"), F.lit(False)).alias("allow"), F.coalesce(F.max("block"), F.lit(False)).alias("block"))
               .where("block and not allow").select("component"))
    bad = save(keys.join(blocked, "component").select("key", F.lit("block").alias("passed")), "url-blocked")
    return (base.join(bad, "key", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("action", "passed", F.lit("allow")).alias("verdict")))
