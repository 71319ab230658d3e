"""Raw call-event sources and the bronze sink.

Events arrive as JSON text: one event per line, or batch bodies
``{"events": [...]}``.  ``from_json`` drops unknown fields; malformed text
yields a ``malformed_json`` reason in validation instead of losing the row.

Numbers and booleans are read as the text they came as and typed leniently
afterwards (V4): ``"true"``, ``"0.01"`` and ``3.0`` for a count are values like
``true``, ``0.01`` and ``3``; what cannot be typed is NULL and its field is named
in the event's ``_bad`` list (``bad_<field>``), so one bad value costs a reason
of its own and not the whole record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CALL_EVENT

CORRUPT = "_corrupt_record"
BAD = "_bad"
TRUE_TEXTS, FALSE_TEXTS = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")


def wire_type(t: T.DataType) -> T.DataType:
    """``t`` as it is read: booleans and numbers as text."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, wire_type(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(wire_type(t.elementType))
    return T.StringType() if isinstance(t, (T.BooleanType, T.IntegerType, T.DoubleType)) else t


def lenient(text: Column, t: T.DataType) -> Column:
    """Text as a boolean, whole number or number; NULL where it is none."""
    if isinstance(t, T.BooleanType):
        low = F.lower(text)
        return F.when(low.isin(*TRUE_TEXTS), F.lit(True)).when(low.isin(*FALSE_TEXTS), F.lit(False))
    if isinstance(t, T.IntegerType):
        n = F.trim(text).try_cast("decimal(38,10)")
        return F.when(n == F.floor(n), n.try_cast("int"))
    return F.trim(text).try_cast("double")


def typed(wire: Column, t: T.DataType) -> Column:
    """A value read as ``wire_type(t)`` in its declared type."""
    if wire_type(t) == t:
        return wire
    if isinstance(t, T.StructType):
        return F.when(wire.isNotNull(), F.struct(*[typed(wire[f.name], f.dataType).alias(f.name) for f in t.fields]))
    if isinstance(t, T.ArrayType):
        return F.transform(wire, lambda x: typed(x, t.elementType))
    return lenient(wire, t)


def untyped(wire: Column, t: T.StructType) -> list[tuple[str, Column]]:
    """``(bad_<field>, condition)`` for every field of ``t`` that holds something its type cannot take."""
    out: list[tuple[str, Column]] = []
    for f in t.fields:
        col, kind = wire[f.name], f.dataType
        if wire_type(kind) == kind:
            continue
        if isinstance(kind, T.StructType):
            out += untyped(col, kind)
        elif isinstance(kind, T.ArrayType):
            out.append((f"bad_{f.name}", F.coalesce(F.exists(
                col, lambda x: F.array_contains(F.array(*[c for _, c in untyped(x, kind.elementType)]), True)), F.lit(False))))
        else:
            out.append((f"bad_{f.name}", col.isNotNull() & lenient(col, kind).isNull()))
    return out


WIRE_EVENT = T.StructType(wire_type(CALL_EVENT).fields + [T.StructField(CORRUPT, T.StringType())])
BATCH = T.StructType([T.StructField("events", T.ArrayType(wire_type(CALL_EVENT))), T.StructField(CORRUPT, T.StringType())])
READ_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def _typed_rows(rows: DataFrame, wire: str, out: str, single: bool) -> DataFrame:
    """The typed event of each row; it comes out of a generator, so what reads its fields later does not type it again."""
    w = F.col(wire)
    bad = F.array(*[F.when(cond, F.lit(name)) for name, cond in untyped(w, CALL_EVENT)])
    event = F.struct(*[typed(w[f.name], f.dataType).alias(f.name) for f in CALL_EVENT.fields],
                     *([w[CORRUPT].alias(CORRUPT)] if single else []), F.array_compact(bad).alias(BAD))
    return rows.select(*[c for c in rows.columns if c != wire], F.explode(F.array(F.when(w.isNotNull(), event))).alias(out))


def parse_events(df: DataFrame, payload_col: str = "payload", out: str = "e") -> DataFrame:
    """Parse one event per row (PERMISSIVE); keeps the raw text for audit.

    A single event is handled as a batch of one: the parsed struct comes out of
    a generator, so later filters on its fields stay above it and the JSON is
    parsed once per row (a filter pushed through a plain projection would
    re-parse it once per referenced field).
    """
    one = F.array(F.from_json(F.col(payload_col), WIRE_EVENT, READ_OPTIONS))
    return _typed_rows(df.select("*", F.posexplode_outer(one).alias("batch_pos", "__wire")), "__wire", out, True)


def parse_batches(df: DataFrame, payload_col: str = "payload", out: str = "e") -> DataFrame:
    """Batch bodies ``{"events": [...]}`` -> one row per event (posexplode keeps position)."""
    parsed = df.withColumn("__b", F.from_json(F.col(payload_col), BATCH, READ_OPTIONS))
    # a malformed body yields one row with a NULL event (rejected as malformed_json)
    rows = parsed.select("*", F.posexplode_outer("__b.events").alias("batch_pos", "__wire")).drop("__b")
    return _typed_rows(rows, "__wire", out, False)


def read_json_events(spark: SparkSession, path: str, batched: bool = False) -> DataFrame:
    """Newline-delimited JSON files (one event, or with ``batched`` one batch body, per line), ready for ``ingest``.

    ``received_at`` is the file's modification time and ``event_id`` a hash of the file, the line's text and the place
    in its batch: reading a file again gives the same ids, and equal lines of one file are one delivery.
    """
    raw = spark.read.text(path).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("__file"),
                                       F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("received_at"))
    rows = parse_batches(raw) if batched else parse_events(raw)
    return rows.withColumn("event_id", F.xxhash64("__file", "payload", "batch_pos")).drop("__file")


def stream_json_events(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S3: continuous source over a folder of JSON files (rate-limited per trigger)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parse_events(reader.load(path).withColumnRenamed("value", "payload"))


def bronze(df: DataFrame, received_at: Column | str = "received_at") -> DataFrame:
    """Audit rows with status RECEIVED and a date partition column."""
    r = F.col(received_at) if isinstance(received_at, str) else received_at
    return (df.withColumn("event_status", F.lit("RECEIVED"))
            .withColumn("attempts", F.lit(0))
            .withColumn("dt", F.to_date(r)))


def write_bronze(df: DataFrame, path: str, mode: str = "append") -> None:
    """S4 sink: Parquet partitioned by receive date (retention drops whole dates)."""
    df.write.mode(mode).partitionBy("dt").parquet(path)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """Idempotent column drop (no-op when absent)."""
    return df.drop(name) if name in df.columns else df


def payloads_from_events(events: DataFrame) -> DataFrame:
    """JSON call-event payloads derived from the ``events`` table (fixture for S1).

    Same id / status / latency rules as the raw event view: repeated ids,
    out-of-domain status (``bogus``) and negative latencies are present.
    """
    eid = F.col("event_id")
    et = F.col("event_type")
    m4 = eid % 4
    raw_id = F.when(eid % 7 == 0, eid - eid % 14).otherwise(eid)
    provider = (F.when(m4 == 0, "openai").when(m4 == 1, "anthropic").when(m4 == 2, "google")
                .otherwise("ollama"))
    model = (F.when(m4 == 0, F.when(eid % 8 == 0, "gpt-4o-mini").otherwise("gpt-4o"))
             .when(m4 == 1, "claude-3-5-haiku-latest").when(m4 == 2, "gemini-1.5-flash")
             .otherwise(F.when(eid % 8 == 3, "gemma3:4b").otherwise("llama3.2:latest")))
    status = F.when(et == "error", "error").when(et == "view", "bogus").otherwise("success")
    latency = F.floor(F.col("value") * 20).cast("int") - 40
    no_usage = eid % 17 == 0
    usage = F.when(~no_usage, F.struct(
        (F.lit(50) + (eid * 37) % 1951).cast("int").alias("prompt_tokens"),
        (F.lit(20) + (eid * 53) % 781).cast("int").alias("completion_tokens")))
    ts_text = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    payload = F.struct(
        F.concat(F.lit("evt-"), F.lpad(raw_id.cast("string"), 8, "0")).alias("id"),
        F.col("user_id").cast("string").alias("conversation_id"),
        provider.alias("provider"), model.alias("model"), status.alias("status"),
        ts_text.alias("started_at"), ts_text.alias("ended_at"),
        latency.alias("latency_ms"),
        F.when(eid % 3 != 0, (F.lit(80) + (eid * 11) % 421).cast("int")).alias("ttft_ms"),
        (eid % 5 > 1).alias("streamed"),
        F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("props").alias("content")))
                 .alias("messages")).alias("request"),
        F.struct(et.alias("content"), F.lit("stop").alias("finish_reason")).alias("response"),
        usage.alias("usage"),
        F.when(et == "error", F.struct(F.lit("upstream_error").alias("type"),
                                       F.col("props").alias("message"))).alias("error"),
        F.lit("0.1.0").alias("sdk_version"),
    )
    return events.select(eid.alias("event_id"), F.col("ts").alias("received_at"),
                         F.to_json(payload).alias("payload"))


def kafka_json_events(spark: SparkSession, bootstrap_servers: str, topic: str,
                      starting_offsets: str = "latest", max_offsets_per_trigger: int | None = None) -> DataFrame:
    """S3 over Kafka: one JSON event per message (needs the Spark Kafka connector on the classpath).

    ``event_id`` is derived from (partition, offset), so a replayed message keeps
    its id and the downstream fold stays idempotent; ``received_at`` is the
    broker timestamp.  ``max_offsets_per_trigger`` bounds each micro-batch (L5).
    """
    return parse_events(kafka_payloads(spark, bootstrap_servers, topic, starting_offsets, max_offsets_per_trigger))


def kafka_payloads(spark: SparkSession, bootstrap_servers: str, topic: str, starting_offsets: str = "latest",
                   max_offsets_per_trigger: int | None = None) -> DataFrame:
    """The unparsed messages of a topic as ``event_id, received_at, payload``, the input of an ingest job."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
         .option("subscribe", topic).option("startingOffsets", starting_offsets))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    return r.load().select(
        (F.col("partition").cast("long") * F.lit(1 << 40) + F.col("offset")).alias("event_id"),
        F.col("timestamp").alias("received_at"),
        F.col("value").cast("string").alias("payload"))


def to_kafka_rows(df: DataFrame, key_col: str = "id") -> DataFrame:
    """S8 sink shape: (key, value JSON) rows for ``writeStream.format("kafka")``."""
    return df.select(F.col(key_col).cast("string").alias("key"),
                     F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def loose_payloads(events: DataFrame) -> DataFrame:
    """Payloads whose numbers and booleans come as text, some of them unreadable (fixture for V4)."""
    eid = F.col("event_id")
    at = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    switch = F.when(eid % 12 == 3, "maybe").when(eid % 4 == 0, "true").when(eid % 4 == 1, "No").when(eid % 4 == 2, "1").otherwise("off")
    tokens = F.when(eid % 9 == 8, "x").when(eid % 3 == 0, "37").when(eid % 3 == 1, "7.0").otherwise(" 5 ")
    cost = F.when(eid % 14 == 5, "free").when(eid % 2 == 0, "0.01").otherwise("2")
    payload = F.struct(
        F.concat(F.lit("evt-"), F.lpad(eid.cast("string"), 8, "0")).alias("id"), F.lit("openai").alias("provider"),
        F.lit("gpt-4o").alias("model"), F.lit("success").alias("status"), at.alias("started_at"), at.alias("ended_at"),
        (eid % 5000).alias("latency_ms"), switch.alias("streamed"), F.struct(F.col("props").alias("prompt")).alias("request"),
        F.struct(tokens.alias("prompt_tokens")).alias("usage"), cost.alias("cost_usd"))
    return events.select("event_id", F.col("ts").alias("received_at"), F.to_json(payload).alias("payload"))


def batch_bodies(events: DataFrame, size: int = 50) -> DataFrame:
    """``value``: the events' payloads in batch bodies of at most ``size`` events, one per line (fixture for S1)."""
    own = payloads_from_events(events).withColumn("__body", F.floor(F.col("event_id") / size))
    return (own.groupBy("__body").agg(F.array_join(F.collect_list("payload"), ",").alias("all"))
            .select(F.concat(F.lit('{"events":['), F.col("all"), F.lit("]}")).alias("value")))
