"""Redaction operators over tables.

The pattern chain is applied in stages, one projection per pattern, so each
stage reads the previous stage's text once (no exponential expression trees,
and Catalyst keeps the stages apart because regexes are not cheap to repeat).
Arrays of messages are redacted element-wise with ``transform`` per stage; the
per-type counts are summed over the array with ``aggregate`` (R10/R11).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pii import PII_TYPES, count_matches, detections, flags, has_digits, ordered, stage

_T = "__pii_text"
_D = "__pii_digit"


def barrier(df: DataFrame) -> DataFrame:
    """Keep later filters above the redaction stages.

    Spark pushes a filter through projections by inlining their expressions;
    over the staged chain (each stage reads the previous text several times)
    that would re-run the regexes exponentially often.  Filters cannot move
    below a generator on its output, so the rows pass through ``inline`` of a
    one-element array (same columns, one pass).
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def redact_column(df: DataFrame, text_col: str, out_col: str | None = None, count_prefix: str = "pii_",
                  order: str = "reference", unicode_classes: bool = True,
                  enabled: bool = True, with_detections: bool = True) -> DataFrame:
    """R9 over one string column.

    Adds ``out_col`` (redacted text, default: replace ``text_col``), one count
    column per type (``pii_email`` ...) and ``pii_detections`` (types found, in
    catalog order).  ``enabled=False`` (R13) leaves the text and reports no
    detections.
    """
    out_col = out_col or text_col
    if not enabled:
        out = df.withColumn(out_col, F.col(text_col))
        for name in PII_TYPES:
            out = out.withColumn(count_prefix + name, F.lit(0))
        if with_detections:
            out = out.withColumn("pii_detections", detections({}))
        return out
    fl = flags(unicode_classes)
    out = df.withColumns({_T: F.col(text_col), _D: has_digits(F.col(text_col), fl)})
    digit = F.col(_D)
    for p in ordered(order):
        # count first; the replace pass runs only on texts with at least one match
        n_col = count_prefix + p.name
        if p.validate_card:
            t, n = stage(F.col(_T), p, unicode_classes, digit)
            out = out.withColumns({n_col: F.coalesce(n, F.lit(0)).cast("int"), _T: t})
        else:
            out = out.withColumn(n_col, F.coalesce(count_matches(F.col(_T), p, fl, digit), F.lit(0)).cast("int"))
            t, _ = stage(F.col(_T), p, unicode_classes)
            out = out.withColumn(_T, F.when(F.col(n_col) > 0, t).otherwise(F.col(_T)))
    out = out.drop(_D)
    out = out.withColumn(out_col, F.col(_T)).drop(_T) if out_col != _T else out
    if with_detections:
        out = out.withColumn("pii_detections",
                             detections({n: F.col(count_prefix + n) for n in PII_TYPES}))
    return barrier(out)


# Joins message contents for one regex pass.  '&' is a non-word character that
# no pattern class contains (the secret-value class stops at it), so no match
# can reach or cross the separator and word boundaries behave as at string
# ends.  Inside a content every \x01 gets a \x02 behind it, so the separator's
# \x01 before '&' occurs in no content and joining can always be undone.
SEPARATOR = "&\u0001&"
SEPARATOR_RX = "&\\x01&"


def pack_text(c: Column) -> Column:
    return F.replace(c, F.lit("\u0001"), F.lit("\u0001\u0002"))


def unpack_text(c: Column) -> Column:
    return F.replace(c, F.lit("\u0001\u0002"), F.lit("\u0001"))


def redact_messages(df: DataFrame, messages_col: str = "messages", order: str = "reference",
                    unicode_classes: bool = True, det_col: str = "messages_detections",
                    enabled: bool = True) -> DataFrame:
    """Redact ``content`` of every message; counts summed over the list.

    The contents of one list are joined with ``SEPARATOR``, redacted with the
    staged top-level chain (code-generated, one pass per pattern), and split
    back; NULL contents stay NULL.  Equivalent to redacting each message on
    its own because no match can touch the separator.
    """
    if not enabled:  # R13: one switch for logs and messages alike
        return df.withColumn(det_col, detections({}))
    joined = F.array_join(F.transform(messages_col, lambda m: F.coalesce(pack_text(m["content"]), F.lit(""))), SEPARATOR)
    out = df.withColumn("__msg_text", joined)
    out = redact_column(out, "__msg_text", count_prefix="__mc_", order=order, unicode_classes=unicode_classes,
                        with_detections=False)
    parts = F.split(F.col("__msg_text"), SEPARATOR_RX, -1)
    n = F.size(messages_col)
    merged = F.zip_with(F.col(messages_col), F.slice(parts, 1, F.greatest(n, F.lit(1))), lambda m, p: F.when(
        m.isNotNull(), m.withField("content", F.when(m["content"].isNotNull(), unpack_text(p)))))
    fixed = F.when(n > 0, merged).otherwise(F.col(messages_col))  # NULL elements stay NULL elements
    counts = {name: F.when(n > 0, F.col("__mc_" + name)).otherwise(F.lit(0)) for name in PII_TYPES}
    out = (out.withColumn(messages_col, fixed).withColumn(det_col, detections(counts))
           .drop("__msg_text", *["__mc_" + name for name in PII_TYPES]))
    return barrier(out)


def redact_payload(df: DataFrame, messages_col: str, response_col: str, order: str = "reference",
                   enabled: bool = True) -> DataFrame:
    """Request messages + response content; detections concatenated, NULL when empty."""
    if not enabled:
        return df.withColumn("pii_detections", F.lit(None).cast("array<struct<type:string,count:int>>"))
    out = redact_messages(df, messages_col, order, det_col="__req_det", enabled=enabled)
    out = redact_column(out, response_col, count_prefix="__resp_", order=order, with_detections=False)
    resp = detections({n: F.col("__resp_" + n) for n in PII_TYPES})
    both = F.concat(F.col("__req_det"), resp)
    return (out.withColumn("pii_detections", F.when(F.size(both) > 0, both))
            .drop("__req_det", *["__resp_" + n for n in PII_TYPES]))


def detection_report(df: DataFrame, det_col: str = "pii_detections") -> DataFrame:
    """``count x type`` over all rows: type, total count, rows with the type."""
    e = df.select(F.explode_outer(det_col).alias("d")).filter(F.col("d").isNotNull())
    return (e.groupBy(F.col("d.type").alias("type"))
            .agg(F.sum("d.count").cast("long").alias("total_count"),
                 F.count(F.lit(1)).alias("rows_with_type")))


def pii_totals(redacted: DataFrame, count_prefix: str = "pii_") -> DataFrame:
    """Per type: rows with at least one match and total matches (one global aggregate)."""
    aggs = []
    for n in PII_TYPES:
        aggs += [F.count_if(F.col(count_prefix + n) > 0).alias(f"{n}__rows"),
                 F.sum(count_prefix + n).cast("long").alias(f"{n}__matches")]
    wide = redacted.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("type"), F.col(f"{n}__rows").alias("rows"),
                                         F.col(f"{n}__matches").alias("matches")) for n in PII_TYPES]))
    return wide.select(stack.alias("s")).select("s.type", "s.rows", "s.matches")
