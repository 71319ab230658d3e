"""Structured Streaming jobs.

Every job reads the event table as a file stream, applies the same operators as
the batch path, and lands each micro-batch with ``foreachBatch`` under
``<root>/data/batch_id=<n>`` (overwrite per batch id, so a retried batch replaces
its own output: idempotent).  Aggregates land one additive partial row per key
and micro-batch and are summed when read, so they keep no state, and late rows
count like any other.  ``root`` is a folder of the deployment's choice: a job
started again with the same ``root`` goes on from its checkpoint there.  Without
one, a fresh folder below the shared checkpoint folder is used.

``run_*`` functions drive a job to completion with ``availableNow`` (files are
taken ``max_files_per_trigger`` at a time) and return a batch DataFrame over the
landed output; ``start`` takes any trigger (L5: e.g. ``"2 seconds"``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import truncate_error_message
from ..operators.ingest import audit_rows, check_events, check_parents, fact_columns, facts_of, lifecycle_of, live_row
from ..operators.merge import failed_events, fold_latest, latest_per_key
from ..operators.rollup import reaggregate, rollup
from ..schemas import DEFAULT_AS_OF, RANGE_BUCKET, RANGE_INTERVAL
from ..session import scratch_path
from ..sources.admission import stream_json_lines
from ..sources.events import bronze, parse_events, payloads_from_events
from ..sources.fixtures import chunks_from_events, logs_from_events
from ..sources.tables import read_table
from .stores import SPAN_CHUNK, SPAN_ROW, FactStore, RollupStore, SpanStore


def table_stream(spark: SparkSession, sf_dir: str, table: str = "events",
                 max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """S3: a Parquet table folder read as a stream (schema from the file footer).

    ``glob`` selects the files of the table (default ``<table>.parquet``); new
    files arriving in the folder are picked up by later micro-batches.
    """
    schema = (spark.read.option("pathGlobFilter", glob).parquet(sf_dir) if glob else read_table(spark, sf_dir, table)).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob or f"{table}.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(sf_dir)


def _land(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}")
    return write


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep operator state in RocksDB (off-heap, spills to local disk, checkpointed
    incrementally) unless the session already chose a provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    cur = spark.conf.get(key, None)
    if not cur or cur.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKSDB)
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def state_partitions(spark: SparkSession) -> int:
    """Default number of state partitions: the cluster's task slots (fixed at a query's first start)."""
    return max(1, spark.sparkContext.defaultParallelism)


def _start_with_partitions(writer, spark: SparkSession, partitions: int | None):
    """Start a query with a chosen shuffle/state partition count.

    Stateful operators keep the partition count of their first run in the
    checkpoint; it is set here from the cluster size instead of inheriting a
    generic session default.  The session setting is restored after start
    (the running query works on its own session clone).
    """
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(partitions or state_partitions(spark)))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, old)


def start(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append",
          trigger: dict | None = None, partitions: int | None = None, root: str | None = None,
          per_batch=None) -> tuple[object, str]:
    """Start a landed job; returns (StreamingQuery, data path).

    ``trigger`` defaults to availableNow; L5 (micro-batch every 2 s) is
    ``{"processingTime": "2 seconds"}`` with ``maxFilesPerTrigger`` on the source.
    ``per_batch`` is applied to each micro-batch before it lands.
    """
    use_rocksdb_state(spark)
    root = root or scratch_path(spark, name)
    data = f"{root}/data"
    land = _land(data)
    w = (stream.writeStream.outputMode(mode)
         .foreachBatch(land if per_batch is None else lambda batch, batch_id: land(per_batch(batch), batch_id))
         .option("checkpointLocation", f"{root}/checkpoint"))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return _start_with_partitions(w, spark, partitions), data


def landed(spark: SparkSession, data: str, schema: T.StructType) -> DataFrame:
    """The rows that landed below ``data``; none if no batch has landed there yet."""
    folder = getattr(spark._jvm, "org.apache.hadoop.fs.Path")(data)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(data)


def run(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append", root: str | None = None,
        per_batch=None, schema: T.StructType | None = None) -> DataFrame:
    """Run to completion (availableNow) and return the landed rows (with batch_id)."""
    q, data = start(stream, spark, name, mode, root=root, per_batch=per_batch)
    q.awaitTermination()
    return landed(spark, data, _with_batch(schema or stream.schema))


def _event_time(df: DataFrame, col: str, out: str = "__t") -> DataFrame:
    return df.withColumn(out, F.col(col).cast("timestamp"))


# --- L3 / L4: windowed aggregates ----------------------------------------------------------

def run_rollup(spark: SparkSession, sf_dir: str, width: str = "1 minute", root: str | None = None,
               max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """L3: streaming one-minute rollup.  Each micro-batch lands its own rollup; reading sums them."""
    logs = logs_from_events(table_stream(spark, sf_dir, max_files_per_trigger=max_files_per_trigger, glob=glob))
    schema = rollup(logs, width).schema
    parts = run(logs, spark, "stream-rollup", root=root, per_batch=lambda b: rollup(b, width), schema=schema)
    return reaggregate(parts.drop("batch_id"), width).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def run_series(spark: SparkSession, sf_dir: str, range_key: str = "24h", group_by: str = "provider",
               as_of: _dt.datetime = DEFAULT_AS_OF, root: str | None = None,
               max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """L4: tumbling dashboard series (request counts).  All buckets land; the trailing range is cut
    when reading, at ``as_of``, so it moves with the reader's clock."""
    logs = logs_from_events(table_stream(spark, sf_dir, max_files_per_trigger=max_files_per_trigger, glob=glob))
    key = F.col(group_by).cast("string") if group_by != "none" else F.lit("all")
    logs = logs.select("created_at", key.alias("series_key"))

    def counts(b: DataFrame) -> DataFrame:
        return (b.groupBy(F.window("created_at", RANGE_BUCKET[range_key]).start.alias("t"), "series_key")
                .agg(F.count(F.lit(1)).cast("double").alias("v"), F.min("created_at").alias("first")))
    # the range may start inside a bucket: rows before it are left out by landing them apart
    lower = F.lit((as_of - RANGE_INTERVAL[range_key]).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    schema = counts(logs).schema
    parts = run(logs, spark, "stream-series", root=root, schema=schema, per_batch=lambda b: counts(
        b.where(F.col("created_at") < lower)).unionByName(counts(b.where(F.col("created_at") >= lower))))
    return (parts.where(F.col("first") >= lower).groupBy("t", "series_key").agg(F.sum("v").alias("v"))
            .withColumn("t", F.col("t").cast("timestamp_ntz")))


# --- L2 / L6 / L1: ingest, dedup, live feed ----------------------------------------------------------

def audited(payloads: DataFrame, redact: bool = True) -> DataFrame:
    """Payload rows (batch or stream) parsed, checked (V1-V7) and in their audit form (R13: redacted unless switched off).

    ``__first`` orders repeats of an event as they came, before redaction.  On a stream this is planned once a job, so a
    micro-batch does not build and analyse the whole chain again.
    """
    came = [c for c in payloads.columns if c != "event_id"]
    rows = payloads.withColumn("__first", F.struct("received_at", F.xxhash64(*came).alias("hash")))
    return audit_rows(check_events(parse_events(rows)), redact=redact)


def land_events(store: FactStore, root: str, batch: DataFrame, batch_id: int, redact: bool = True, parents=None) -> None:
    """One micro-batch of payload rows into the audit rows (S4), facts and lifecycle of ``store``."""
    land_audited(store, root, audited(batch, redact), batch_id, parents)


def land_audited(store: FactStore, root: str, batch: DataFrame, batch_id: int, parents=None, columns=None) -> None:
    """One micro-batch of ``audited`` rows; the rules ran once, and the audit rows are what facts are made of, by
    ``columns`` if the job has built its ``fact_columns``."""
    if batch_id <= store.manifest.read()["batch"]:
        return  # taken in before a stop
    spark = batch.sparkSession
    # the index of seen ids asks a later batch for its dates and ids before its rows are written: one run of the rules serves all
    kept = batch.persist(StorageLevel.MEMORY_AND_DISK) if store.indexed() else batch
    checked = store.unseen(kept, order="__first").drop("__first")
    rows = bronze(checked if parents is None else check_parents(checked, parents()))
    path = f"{root}/raw/batch_id={batch_id}"
    try:
        rows.write.mode("overwrite").parquet(path)
    finally:
        if kept.is_cached:
            kept.unpersist()
    own = spark.read.schema(rows.schema).parquet(path)
    store.apply(own, facts_of(own, columns=columns), lifecycle_of(own).drop("reject_reasons"), batch_id)


def run_upsert(spark: SparkSession, sf_dir: str, fold_columns: tuple[str, ...] | None = None, glob: str | None = None,
               root: str | None = None, max_files_per_trigger: int | None = None, redact: bool = True,
               parents=None, compact_every: int = 8) -> tuple[DataFrame, DataFrame]:
    """L2 + L6: events -> JSON payloads -> validate -> redact -> normalise; returns (facts, lifecycle).

    Every micro-batch lands its raw rows (S4) and joins the store of facts folded by id (M1).  Events that an earlier
    batch brought are left out by the index of seen ids; no row is lost for being late, and rows without an event_id
    are kept one by one.  ``redact=False`` switches redaction off (R13).  ``parents`` gives the table of conversations
    as it is when a batch runs; events of unknown ones fail (V8) until ``replay_events`` finds them.
    """
    payloads = payloads_from_events(table_stream(spark, sf_dir, max_files_per_trigger=max_files_per_trigger, glob=glob))
    root = root or scratch_path(spark, "stream-upsert")
    q = start_ingest(payloads, spark, root, redact, parents, compact_every)
    q.awaitTermination()
    return ingested(payloads, spark, root, fold_columns)


def start_ingest(payloads: DataFrame, spark: SparkSession, root: str, redact: bool = True, parents=None,
                 compact_every: int = 8, trigger: dict | None = None):
    """L2: an ingest job over any stream of ``event_id, received_at, payload`` (tables, JSON lines, Kafka); the running query.

    ``trigger`` defaults to availableNow; L5 is ``{"processingTime": "0 seconds"}`` over ``stream_json_lines``, which cuts
    the batches itself.  Everything lands below ``root``.
    """
    store = FactStore(spark, f"{root}/store", compact_every)
    rows = audited(payloads, redact)
    columns = fact_columns(rows.columns)
    return _start_with_partitions(rows.writeStream.outputMode("append")
                                  .foreachBatch(lambda b, i: land_audited(store, root, b, i, parents, columns))
                                  .option("checkpointLocation", f"{root}/checkpoint").trigger(**(trigger or {"availableNow": True})),
                                  spark, None)


def ingested(payloads: DataFrame, spark: SparkSession, root: str, fold_columns: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """The (facts, lifecycle) below ``root`` now; empty tables of the same columns before the first batch."""
    store = FactStore(spark, f"{root}/store")
    facts, life = store.rows(), store.lifecycle()
    if facts is None:
        none = check_events(parse_events(spark.createDataFrame([], payloads.schema).withColumn("attempts", F.lit(0))))
        facts, life = fold_latest(facts_of(none)), lifecycle_of(none).drop("reject_reasons")
    return (facts.select(*fold_columns, "versions") if fold_columns else facts), life


def run_ingest_lines(spark: SparkSession, path: str, max_events: int = 20, root: str | None = None, redact: bool = True,
                     parents=None) -> tuple[DataFrame, DataFrame]:
    """Take in all JSON lines below ``path`` in micro-batches of at most ``max_events``; returns (facts, lifecycle)."""
    payloads = stream_json_lines(spark, path, max_events, max_wait_ms=0)
    root = root or scratch_path(spark, "stream-lines")
    q = start_ingest(payloads, spark, root, redact, parents, trigger={"processingTime": "0 seconds"})
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return ingested(payloads, spark, root)


def replay_events(spark: SparkSession, root: str, parents: DataFrame | None = None, amend=None, max_attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """M3: the failed events of a job, checked again under today's rules; returns (facts, lifecycle) after it.

    ``root`` is the job's folder, ``parents`` today's conversations and ``amend`` an optional change of the parsed rows
    (a mended field).  Each event has an attempt count; after ``max_attempts`` it is a dead letter and stays failed.
    What passes is folded into the facts by its receive time, in the same switch as its lifecycle, so an event is in
    the facts once.  Events without an event_id cannot be named again and are not replayed.
    """
    store = FactStore(spark, f"{root}/store")
    failed = failed_events(store.lifecycle()).where((F.col("attempts") < max_attempts) & F.col("event_id").isNotNull()).select("event_id", "attempts")
    raw = spark.read.parquet(f"{root}/raw").drop("event_status", "attempts", "reject_reasons", "dt", "batch_id")
    rows = raw.join(failed, "event_id")
    rows = check_events(rows if amend is None else amend(rows), parents=parents)
    path = f"{root}/replayed/version={store.manifest.read()['version']}"
    rows.write.mode("overwrite").parquet(path)
    own = spark.read.schema(rows.schema).parquet(path)
    store.apply(own, facts_of(own), lifecycle_of(own).drop("reject_reasons"))
    return store.rows(), store.lifecycle()


def dead_letters(life: DataFrame, max_attempts: int = 3) -> DataFrame:
    """M3: failed events that no replay takes up any more."""
    return failed_events(life).where(F.col("attempts") >= max_attempts)


def run_stored_rollup(spark: SparkSession, sf_dir: str, until: _dt.datetime | None = None, root: str | None = None,
                      max_files_per_trigger: int | None = None, glob: str | None = None) -> RollupStore:
    """Keep a stored minute rollup of the calls (before ``until``, if given) from the event stream."""
    logs = logs_from_events(table_stream(spark, sf_dir, max_files_per_trigger=max_files_per_trigger, glob=glob))
    if until is not None:
        logs = logs.where(F.col("created_at") < F.lit(str(until)).cast(logs.schema["created_at"].dataType))
    root = root or scratch_path(spark, "stored-rollup")
    store = RollupStore(spark, f"{root}/store")
    q = _start_with_partitions(logs.writeStream.outputMode("append").foreachBatch(store.apply)
                               .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True), spark, None)
    q.awaitTermination()
    return store


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())])


def run_live_feed(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    """L1 + T8: lean rows appended per batch; the feed is the newest n."""
    rows = run(live_row(logs_from_events(table_stream(spark, sf_dir))), spark, "stream-live", "append")
    return rows.drop("batch_id").orderBy(F.desc("created_at"), F.desc("id")).limit(n)


# --- L7 / L8: stateful span assembly with timeout -------------------------------------------------------

def _millis(spark: SparkSession, interval: str) -> int:
    """An interval text such as ``10 minutes`` in milliseconds."""
    return spark.sql(f"select unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {interval})").first()[0]


def run_spans(spark: SparkSession, sf_dir: str, timeout: _dt.timedelta = _dt.timedelta(days=1), watermark: str = "10 minutes",
              chunks=chunks_from_events, glob: str | None = None, root: str | None = None,
              max_files_per_trigger: int | None = None, compact_every: int = 8) -> DataFrame:
    """Stateful span assembly; at the end of the input, spans still open ended with their stream.

    ``chunks`` maps the event stream to chunk rows; the open spans are kept in a ``SpanStore``.  Rows later than
    ``watermark`` are dropped: choose it as long as files may be late.
    """
    c = chunks(table_stream(spark, sf_dir, max_files_per_trigger=max_files_per_trigger, glob=glob))
    if "kind" not in c.columns:
        c = c.withColumn("kind", F.when(F.col("is_error"), F.lit("error")).otherwise(F.lit("chunk")))
    c = c.withColumns({n: F.lit(None).cast("string") for n in ("error_type", "error_message") if n not in c.columns})
    c = c.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).where("seq is not null and us is not null")
    c = c.select(*T.StructType.fromDDL(SPAN_CHUNK).names)
    root = root or scratch_path(spark, "stream-spans")
    store = SpanStore(spark, root, int(timeout.total_seconds() * 1000), _millis(spark, watermark), compact_every=compact_every)
    # the batch's own joins and groupings keep the session's partition count: no state is tied to it
    q = _start_with_partitions(c.writeStream.outputMode("append").foreachBatch(store.apply)
                               .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True),
                               spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q.awaitTermination()
    store.expire()
    cur = latest_per_key(landed(spark, f"{root}/data", _with_batch(T.StructType.fromDDL(SPAN_ROW))), "span_id")
    ts = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    from ..functions.normalize import total_tokens
    return cur.select(
        "span_id", F.coalesce("status", F.lit("SUCCESS")).alias("status"),
        ts("started_us").alias("started_at"), ts("ended_us").alias("ended_at"),
        F.floor((F.col("ended_us") - F.col("started_us")) / 1000).cast("long").alias("latency_ms"),
        F.floor((F.col("first_token_us") - F.col("started_us")) / 1000).cast("long").alias("ttft_ms"),
        F.coalesce("output_text", F.lit("")).alias("output_text"), "prompt_tokens", "completion_tokens",
        total_tokens("prompt_tokens", "completion_tokens").alias("total_tokens"), "chunk_count", "error_type",
        truncate_error_message("error_message").alias("error_message"), F.lit(True).alias("streamed"))
