"""Row-state changes as table operators.

No table format with MERGE is assumed: facts are kept as an append-only log
(partitioned by date, one folder per micro-batch for streams) and the current
state is a fold by key.  The fold is a plain ``groupBy(id)`` of ``max_by`` /
``min_by`` aggregates; these combine map-side, so a hot id (even a third of
all rows) is reduced in every task before the shuffle and never gathered into
one task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns replaced by a later event with the same id (also by NULL);
# every other column keeps its first value.
MUTABLE_COLUMNS = ("status", "error_type", "error_message", "prompt_tokens", "completion_tokens",
                   "total_tokens", "cost_usd", "pii_detections", "input_preview", "output_preview")


def fold_latest(df: DataFrame, key: str = "id", order: list[str] | None = None,
                mutable: tuple[str, ...] = MUTABLE_COLUMNS, versions_col: str | None = "versions") -> DataFrame:
    """Mixed first/last-write fold of repeated rows by ``key``.

    ``order`` (default ``created_at, event_id``) ranks versions; mutable
    columns take the value of the latest version (``max_by``, NULL included),
    the others the first version's (``min_by``).  Each side is one struct
    aggregate, so select the needed columns before folding (columns inside the
    structs are not pruned afterwards).
    """
    order = order or [c for c in ("created_at", "event_id") if c in df.columns]
    ord_col = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    cols = [c for c in df.columns if c != key]
    latest = [c for c in cols if c in mutable]
    first = [c for c in cols if c not in mutable]
    # one struct per side: the values of the latest / first version travel together
    aggs = []
    if latest:
        aggs.append(F.max_by(F.struct(*latest), ord_col).alias("__latest"))
    if first:
        aggs.append(F.min_by(F.struct(*first), ord_col).alias("__first"))
    if versions_col:
        aggs.append(F.count(F.lit(1)).alias(versions_col))
    out = df.groupBy(key).agg(*aggs)
    sel = [key] + [F.col(f"__latest.{c}" if c in mutable else f"__first.{c}").alias(c) for c in cols]
    return out.select(*sel, *([versions_col] if versions_col else []))


def event_status_counts(lifecycle: DataFrame) -> DataFrame:
    """Events per lifecycle status."""
    return lifecycle.groupBy("status").agg(F.count(F.lit(1)).alias("events"))


def stuck_events(lifecycle: DataFrame, as_of: _dt.datetime, older_than: _dt.timedelta) -> DataFrame:
    """Events still RECEIVED after ``older_than``."""
    lim = F.lit((as_of - older_than).strftime("%Y-%m-%d %H:%M:%S")).cast(
        lifecycle.schema["received_at"].dataType)
    return lifecycle.filter((F.col("status") == "RECEIVED") & (F.col("received_at") < lim))


def failed_events(lifecycle: DataFrame) -> DataFrame:
    """F8: the replay set."""
    return lifecycle.filter(F.col("status") == "FAILED")


def replay_failed(raw: DataFrame, lifecycle: DataFrame, process, key: str = "event_id") -> DataFrame:
    """M3: FAILED -> RECEIVED (error cleared) -> processed again by ``process``.

    ``process(raw_rows) -> lifecycle_rows``.  The replay set is a semi join of
    the raw log with the failed ids, so only failed events are re-read.
    """
    again = raw.join(failed_events(lifecycle).select(key), key, "left_semi")
    return process(again).withColumn("attempts", F.lit(1))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent (left anti join)."""
    keys = parent.select(F.col(parent_key).alias("__pk")).distinct()
    return (child.filter(F.col(child_key).isNotNull())
            .join(keys, F.col(child_key) == F.col("__pk"), "left_anti"))


def keep_with_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Cascade delete = keep children whose parent survives (left semi join)."""
    keys = parent.select(F.col(parent_key).alias("__pk"))
    return child.join(keys, F.col(child_key) == F.col("__pk"), "left_semi")


def mark_processed(events: DataFrame, facts: DataFrame, event_key: str = "event_id") -> DataFrame:
    """Event rows -> PROCESSED when a fact row carries their event id, else RECEIVED."""
    done = facts.select(F.col(event_key).alias("__done")).distinct()
    j = events.join(done, F.col(event_key) == F.col("__done"), "left")
    return (j.withColumn("status", F.when(F.col("__done").isNotNull(), F.lit("PROCESSED"))
                         .otherwise(F.lit("RECEIVED"))).drop("__done"))


def archive(conversations: DataFrame, ids: DataFrame, as_of: _dt.datetime, key: str = "conversation_id") -> DataFrame:
    """M4: soft delete (status ARCHIVED, updated_at bumped) for the ids in ``ids``."""
    hit = ids.select(F.col(key).alias("__aid")).distinct()
    j = conversations.join(hit, F.col(key) == F.col("__aid"), "left")
    now = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast(conversations.schema["updated_at"].dataType)
    return (j.withColumn("status", F.when(F.col("__aid").isNotNull(), F.lit("ARCHIVED")).otherwise(F.col("status")))
            .withColumn("updated_at", F.when(F.col("__aid").isNotNull(), now).otherwise(F.col("updated_at")))
            .drop("__aid"))


def touch(conversations: DataFrame, messages: DataFrame, key: str = "conversation_id",
          msg_time: str = "created_at") -> DataFrame:
    """M5: updated_at = greatest(updated_at, newest message time)."""
    last = messages.groupBy(key).agg(F.max(msg_time).alias("__last"))
    return (conversations.join(last, key, "left")
            .withColumn("updated_at", F.greatest(F.col("updated_at"), F.col("__last"))).drop("__last"))


def purge_before(df: DataFrame, cutoff: _dt.date, date_col: str = "dt") -> DataFrame:
    """M6: retention as a partition filter (whole dates are dropped on rewrite)."""
    return df.filter(F.col(date_col) >= F.lit(cutoff))


def latest_per_key(df: DataFrame, key: list[str] | str, order: str = "batch_id") -> DataFrame:
    """Fold an append-only change log (e.g. streaming update batches) to the newest row per key."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(*[F.max_by(c, F.col(order)).alias(c) for c in cols])


def col_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


# --- re-foldable state: compaction of an append-only log ------------------------------------------

def fold_state(df: DataFrame, key: str = "id", order: list[str] | None = None,
               mutable: tuple[str, ...] = MUTABLE_COLUMNS) -> DataFrame:
    """Partial fold that can be folded again: per key the first / latest version with their order keys.

    ``merge_states(fold_state(a) ∪ fold_state(b)) == fold_state(a ∪ b)``, so an
    append-only log can be compacted into a snapshot and later batches folded
    onto it without re-reading history.
    """
    order = order or [c for c in ("created_at", "event_id") if c in df.columns]
    ordc = F.struct(*[F.col(c) for c in order])
    cols = [c for c in df.columns if c != key]
    latest = [c for c in cols if c in mutable]
    first = [c for c in cols if c not in mutable]
    return df.groupBy(key).agg(
        F.min(ordc).alias("__first_ord"), F.min_by(F.struct(*first), ordc).alias("__first"),
        F.max(ordc).alias("__last_ord"), F.max_by(F.struct(*latest), ordc).alias("__latest"),
        F.count(F.lit(1)).alias("versions"))


def merge_states(states: DataFrame, key: str = "id") -> DataFrame:
    """Fold several partial states of the same keys into one."""
    return states.groupBy(key).agg(
        F.min("__first_ord").alias("__first_ord"), F.min_by("__first", "__first_ord").alias("__first"),
        F.max("__last_ord").alias("__last_ord"), F.max_by("__latest", "__last_ord").alias("__latest"),
        F.sum("versions").alias("versions"))


def state_rows(states: DataFrame, key: str = "id") -> DataFrame:
    """Current rows (same shape as ``fold_latest``) from a state table."""
    first = [f.name for f in states.schema["__first"].dataType.fields]
    latest = [f.name for f in states.schema["__latest"].dataType.fields]
    return states.select(key, *[F.col(f"__first.{c}").alias(c) for c in first],
                         *[F.col(f"__latest.{c}").alias(c) for c in latest], "versions")


def compact(spark, log_path: str, snapshot_path: str | None, out_path: str, key: str = "id",
            order: list[str] | None = None, mutable: tuple[str, ...] = MUTABLE_COLUMNS,
            after_batch: int | None = None) -> None:
    """Write a new snapshot = merge(old snapshot, fold_state(log batches after ``after_batch``)).

    The result is a written table, so later reads start from it (no lineage back
    to the log); writing to a new path keeps the old snapshot valid until the
    new one is complete.
    """
    log = spark.read.parquet(log_path)
    if after_batch is not None:
        log = log.filter(F.col("batch_id") > after_batch)
    part = fold_state(log.drop("batch_id"), key, order, mutable)
    # the first compaction has no snapshot; one that is named but cannot be read is an error
    states = part if snapshot_path is None else spark.read.parquet(snapshot_path).unionByName(part)
    merge_states(states, key).write.mode("overwrite").parquet(out_path)
