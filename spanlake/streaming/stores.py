"""Tables that a stream keeps up to date: an atomic manifest, stored rollups, folded facts, open spans.

Data files are written first, under names that carry the batch id; a table's readers see them only once a new manifest
names them.  The manifest is one small JSON file per version, put in place by a rename, so a crash before the switch
leaves the old version whole, and the repeated batch overwrites the files that no manifest names.  A batch id the
manifest already covers is not applied again.

What a manifest lists is bounded: one folder per day for a rollup; for facts fewer than ``compact_every`` batches and as
many runs a level, whose number grows with the logarithm of the batches.
"""

from __future__ import annotations

import datetime as _dt
import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import fold_state, merge_states, state_rows
from ..operators.rollup import (SUM_COLUMNS, merge_rollups, rollup_aggs, rollup_with_histogram, summary_from_sums)
from ..operators.spans import END_KINDS
from ..schemas import RANGE_INTERVAL, RESPONSE_CONTENT_CHARS


def _path(spark: SparkSession, path: str):
    # the class by its whole name: package by package, the JVM looks through its jars for each
    p = getattr(spark._jvm, "org.apache.hadoop.fs.Path")(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Manifest:
    """The current version of a table: a JSON object, replaced as a whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root}/_manifest"

    def _versions(self) -> list[int]:
        fs, folder = _path(self.spark, self.folder)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self) -> dict:
        """The newest version's content; ``{"version": 0, "batch": -1}`` before the first."""
        have = self._versions()
        if not have:
            return {"version": 0, "batch": -1}
        fs, p = _path(self.spark, f"{self.folder}/{have[-1]:012d}.json")
        stream = fs.open(p)
        try:
            text = getattr(self.spark._jvm, "org.apache.commons.io.IOUtils").toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def switch(self, content: dict) -> dict:
        """Make ``content`` the next version; fails if another writer took that version."""
        content = {**content, "version": content["version"] + 1}
        fs, tmp = _path(self.spark, f"{self.folder}/tmp-{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        _, to = _path(self.spark, f"{self.folder}/{content['version']:012d}.json")
        if fs.exists(to) or not fs.rename(tmp, to):
            fs.delete(tmp, False)
            raise RuntimeError(f"version {content['version']} of {self.folder} was written by another job")
        for old in self._versions()[:-3]:
            fs.delete(_path(self.spark, f"{self.folder}/{old:012d}.json")[1], False)
        return content


def _read(spark: SparkSession, folders: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _together(spark: SparkSession, works: list) -> list:
    """The results of independent jobs that run at the same time, under the caller's job settings."""
    with ThreadPoolExecutor(len(works)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(w)) for w in works]]


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete the data folders below a store's ``root`` that its manifest no longer names; returns their number.

    For times when no job writes and no older read is open: a plan made before the last switch may still read them.
    """
    now = Manifest(spark, root).read()
    named = [*now.get("batches", []), *now.get("life", []), *([now["snapshot"]] if now.get("snapshot") else []), *now.get("runs", []),
             *(f for folders in now.get("seen", {}).values() for f in folders), *now.get("days", {}).values()]
    gone = 0
    for kind in ("folded", "life", "snapshot", "seen", "days", "parts"):
        fs, folder = _path(spark, f"{root}/{kind}")
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            path = f"{root}/{kind}/{s.getPath().getName()}"
            if not any(n == path or n.startswith(path + "/") for n in named):
                fs.delete(s.getPath(), True)
                gone += 1
    return gone


# --- G16 / L3: stored rollup ------------------------------------------------------------------------

class RollupStore:
    """A minute rollup kept by batches of facts.

    ``apply`` rolls one batch up, merges it into the days it touches and rewrites those days only, so late rows correct
    old buckets and a batch costs its own days, not the history.  The manifest names one folder per day and the
    high-water mark, the newest ``created_at`` taken in.  Facts without ``created_at`` have no bucket.
    """

    def __init__(self, spark: SparkSession, root: str, width: str = "1 minute"):
        self.spark, self.root, self.width = spark, root, width
        self.manifest = Manifest(spark, root)

    def apply(self, facts: DataFrame, batch_id: int) -> None:
        now = self.manifest.read()
        if batch_id <= now["batch"]:
            return
        spark = facts.sparkSession
        own = f"{self.root}/parts/batch_id={batch_id}"
        new = rollup_with_histogram(facts, self.width, marks=True)
        new = new.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("bucket", "mark")}).withColumn("day", F.to_date("bucket"))
        new.write.mode("overwrite").parquet(own)
        new = spark.read.schema(new.schema).parquet(own)
        # one row per day of the batch
        touched = {r.day.isoformat(): r.mark for r in new.groupBy("day").agg(F.max("mark").alias("mark")).collect()}
        if not touched:
            self.manifest.switch({**now, "batch": batch_id})
            return
        days = dict(now.get("days", {}))
        old = _read(spark, [days[d] for d in sorted(touched) if d in days], new.drop("day").schema)
        to = f"{self.root}/days/batch_id={batch_id}"
        merged = merge_rollups(old.unionByName(new.drop("day")), marks=True).withColumn("day", F.to_date("bucket"))
        merged.repartition("day").write.mode("overwrite").partitionBy("day").parquet(to)
        days.update({d: f"{to}/day={d}" for d in touched})
        mark = max(t.isoformat(sep=" ", timespec="microseconds") for t in touched.values())
        self.manifest.switch({**now, "batch": batch_id, "days": days, "mark": max(mark, now.get("mark", mark))})

    def schema(self) -> T.StructType:
        sums = [T.StructField(c, T.DecimalType(14, 6) if c == "sum_cost_usd" else T.LongType()) for c in SUM_COLUMNS]
        return T.StructType([T.StructField("bucket", T.TimestampNTZType()), T.StructField("provider", T.StringType()),
                             T.StructField("model", T.StringType()), *sums,
                             T.StructField("latency_hist", T.MapType(T.IntegerType(), T.LongType()))])

    def rows(self, since: _dt.datetime | None = None) -> DataFrame:
        """The stored rollup rows; only the days from ``since`` on are opened."""
        days = self.manifest.read().get("days", {})
        keep = [days[d] for d in sorted(days) if since is None or d >= since.date().isoformat()]
        return _read(self.spark, keep, self.schema())

    def summary(self, facts: DataFrame, range_key: str, as_of: _dt.datetime) -> DataFrame:
        """The additive summary of a range from the stored rows plus the facts after the high-water mark.

        Buckets at the range's edge are whole minutes, so its start must be aligned to the rollup width.
        """
        lower = as_of - RANGE_INTERVAL[range_key]
        if lower.second or lower.microsecond:
            raise ValueError("range start must be aligned to the rollup width")
        mark = self.manifest.read().get("mark")
        when = facts.schema["created_at"].dataType
        at = lambda v, t: F.lit(str(v)).cast(t)
        old = self.rows(lower).where(F.col("bucket") >= at(lower, T.TimestampNTZType())).select(*SUM_COLUMNS)
        live = facts.where(F.col("created_at") >= at(lower, when))
        if mark:
            live = live.where(F.col("created_at") > at(mark, when))
        return summary_from_sums(old.unionByName(live.agg(*rollup_aggs())), range_key)


# --- M1 / S7 / L6: folded facts with bounded reads ---------------------------------------------------

SMALL_BATCH = 1 << 20  # rows of a batch whose ids are looked up in the index by a broadcast


def _level(folder: str) -> int:
    """How often the rows of a folder were gathered: 0 for what a batch landed; a store of older make gathered all of it."""
    found = re.search(r"/level=(\d+)-version=", folder)
    return int(found[1]) if found else int("/version=" in folder)


def _gather(runs: list[str], every: int) -> tuple[list[str], list[str], int]:
    """Of runs, oldest first, those that stay and those that go into a new run together with new batches, and its level:
    ``every`` runs of a level make one of the next, so a row is written again once a level and not at each compaction."""
    stay, level = list(runs), 1
    while sum(_level(f) <= level for f in stay) >= max(every, 2) - 1:
        stay, level = [f for f in stay if _level(f) > level], level + 1
    return stay, runs[len(stay):], level


class FactStore:
    """Facts folded by id: compacted runs plus the batches after them (M1), and the index of seen events.

    ``apply`` keeps the events of a batch that no earlier batch brought, folds them by id and lands the fold as a batch
    of its own; every ``compact_every`` batches become a run, as many runs a longer run, and so on (the oldest is the
    snapshot).  A read opens fewer than ``compact_every`` batches and runs of each level, and a fact is written again once
    a level however long the job runs.  The index is kept by receive date, and a batch opens the dates it holds only: a
    repeated delivery carries the receive time of the first.
    """

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 8):
        self.spark, self.root, self.compact_every = spark, root, compact_every
        self.manifest = Manifest(spark, root)

    def indexed(self) -> bool:
        """Whether an earlier batch left ids in the index."""
        return bool(self.manifest.read().get("seen"))

    def unseen(self, rows: DataFrame, event_id: str = "event_id", received_at: str = "received_at", order: str | None = None) -> DataFrame:
        """The rows of a batch whose event id is new; of repeats within it one of the earliest stays (the first by the
        column ``order``, if given).  Rows without an event id are no repeats of each other.  Their ids join the index
        when the batch is applied."""
        spark = rows.sparkSession
        others = [c for c in rows.columns if c != event_id]
        first = F.struct(received_at, F.xxhash64(*others)) if order is None else F.col(order)
        # a row without an id is a group of its own, so that one pass over the rows is enough
        lone = F.when(F.col(event_id).isNull(), F.monotonically_increasing_id())
        ids = (rows.withColumn("__lone", lone).groupBy(event_id, "__lone").agg(F.min_by(F.struct(*others), first).alias("r"))
               .select(event_id, "r.*").select(*rows.columns))
        index = self.manifest.read().get("seen", {})
        if not index:
            return ids
        # the dates of one batch and its size
        dates = {str(r.dt): r["count"] for r in rows.select(F.to_date(received_at).alias("dt")).groupBy("dt").count().collect()}
        folders = [f for d in dates for f in index.get(d, [])]
        if folders:
            seen = spark.read.schema(T.StructType([T.StructField(event_id, rows.schema[event_id].dataType)])).parquet(*folders)
            if sum(dates.values()) <= SMALL_BATCH:
                # the index is scanned where it lies for the few ids of the batch, not shuffled
                seen = F.broadcast(seen.join(F.broadcast(rows.select(event_id)), event_id, "left_semi").distinct())
            ids = ids.join(seen, event_id, "left_anti")
        return ids

    def _index(self, now: dict, rows: DataFrame, batch_id: int, event_id: str, received_at: str) -> dict:
        to = f"{self.root}/seen/batch_id={batch_id}"
        new = rows.where(F.col(event_id).isNotNull()).select(event_id, F.to_date(received_at).alias("dt"))
        new.repartition("dt").write.mode("overwrite").partitionBy("dt").parquet(to)
        seen = dict(now.get("seen", {}))
        fs, folder = _path(self.spark, to)
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        for name in (n for n in names if n.startswith("dt=")):
            d = "None" if name == "dt=__HIVE_DEFAULT_PARTITION__" else name[3:]
            seen[d] = [*seen.get(d, []), f"{to}/{name}"]
        return seen

    def apply(self, events: DataFrame, facts: DataFrame, life: DataFrame, batch_id: int | None = None,
              event_id: str = "event_id", received_at: str = "received_at") -> None:
        """Take in one batch: ``events`` are its unseen events (id and receive time), ``facts`` their fact rows, ``life``
        their lifecycle rows.  Without a batch id it is a replay of events seen before (M3).  All of it or nothing
        becomes visible, by one switch."""
        now = self.manifest.read()
        if batch_id is not None and batch_id <= now["batch"]:
            return
        name = f"replay={now['version']}" if batch_id is None else f"batch_id={batch_id}"
        to, told = f"{self.root}/folded/{name}", f"{self.root}/life/{name}"
        writes = [lambda: fold_state(facts).write.mode("overwrite").parquet(to), lambda: life.write.mode("overwrite").parquet(told)]
        if batch_id is not None:
            writes.append(lambda: self._index(now, events, batch_id, event_id, received_at))
        seen = _together(events.sparkSession, writes)[-1]
        new = {**now, "batches": [*now.get("batches", []), to], "life": [*now.get("life", []), told]}
        if batch_id is None:
            new["replays"] = now.get("replays", 0) + 1
        else:
            new.update(batch=batch_id, seen=seen)
        if len(self.manifest.switch(new)["batches"]) >= self.compact_every:
            self.compact()

    def _life(self, now: dict, folders: list[str], event_id: str = "event_id") -> DataFrame | None:
        if not folders:
            return None
        rows = self.spark.read.schema(self.spark.read.parquet(folders[-1]).schema).parquet(*folders)
        if not now.get("replays"):
            return rows
        others = [c for c in rows.columns if c != event_id]
        last = (rows.where(F.col(event_id).isNotNull()).groupBy(event_id).agg(F.max_by(F.struct(*others), "attempts").alias("r"))
                .select(event_id, "r.*").select(*rows.columns))
        return last.unionByName(rows.where(F.col(event_id).isNull()))

    def lifecycle(self) -> DataFrame | None:
        """The newest lifecycle row of every event; None before the first batch."""
        now = self.manifest.read()
        return self._life(now, now.get("life", []))

    @staticmethod
    def _runs(now: dict) -> list[str]:
        return [*([now["snapshot"]] if now.get("snapshot") else []), *now.get("runs", [])]

    def _states(self, folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        schema = self.spark.read.parquet(folders[-1]).schema
        return merge_states(self.spark.read.schema(schema).parquet(*folders))

    def compact(self) -> None:
        """Fold the batches into a new run, with the runs of each level that it makes full; the old ones serve until the switch.

        Lifecycle rows and, of dates that came in several batches, seen ids are gathered likewise."""
        now = self.manifest.read()
        if not now.get("batches"):
            return
        name = lambda level: f"level={level}-version={now['version'] + 1}"
        stay, full, level = _gather(self._runs(now), self.compact_every)
        to = f"{self.root}/snapshot/{name(level)}"
        life = now.get("life", [])
        life_stay, life_full, life_level = _gather([f for f in life if _level(f)], self.compact_every)
        life_full += [f for f in life if not _level(f)]
        told = f"{self.root}/life/{name(life_level)}"
        seen, by_level = dict(now.get("seen", {})), {}
        for d, folders in seen.items():
            new = [f for f in folders if not _level(f)]
            if new and len(folders) > 1:
                kept, taken, at = _gather([f for f in folders if _level(f)], self.compact_every)
                by_level.setdefault(at, {})[d] = [*taken, *new]
                seen[d] = [*kept, f"{self.root}/seen/{name(at)}/dt={'__HIVE_DEFAULT_PARTITION__' if d == 'None' else d}"]

        def gather_seen(at: int, dates: dict[str, list[str]]) -> None:
            rows = None
            for d, folders in dates.items():
                part = self.spark.read.parquet(*folders).withColumn("dt", F.lit(None if d == "None" else d).cast("date"))
                rows = part if rows is None else rows.unionByName(part)
            rows.repartition("dt").write.mode("overwrite").partitionBy("dt").parquet(f"{self.root}/seen/{name(at)}")

        _together(self.spark, [lambda: self._states([*full, *now["batches"]]).write.mode("overwrite").parquet(to),
                               lambda: self._life(now, life_full).write.mode("overwrite").parquet(told),
                               *(lambda at=at, dates=dates: gather_seen(at, dates) for at, dates in by_level.items())])
        runs = [*stay, to]
        self.manifest.switch({**now, "snapshot": runs[0], "runs": runs[1:], "batches": [], "seen": seen, "life": [*life_stay, told]})

    def rows(self) -> DataFrame | None:
        """Current facts, one row per id; None before the first batch."""
        now = self.manifest.read()
        states = self._states([*self._runs(now), *now.get("batches", [])])
        return None if states is None else state_rows(states)


# --- L7 / L8: open spans with timeout --------------------------------------------------------------------

SPAN_CHUNK = ("span_id string, seq long, us long, kind string, delta string, prompt_tokens int, completion_tokens int, "
              "error_type string, error_message string")
SPAN_ROW = ("span_id string, status string, started_us long, ended_us long, first_token_us long, prompt_tokens int, "
            "completion_tokens int, chunk_count long, output_text string, error_type string, error_message string")


def span_rows(chunks: DataFrame, max_chars: int = RESPONSE_CONTENT_CHARS) -> DataFrame:
    """One row per span from all its chunks (``SPAN_CHUNK``); the status is NULL while no end has come.

    A function of the set of chunks: the first end by ``seq`` wins, and what comes after it does not count.  Aggregates
    combine before the shuffle, and of a span's text only its first ``max_chars`` non-empty deltas travel.
    """
    kind, end = F.col("kind"), F.col("__end")
    ends = (chunks.where(kind.isin(*END_KINDS)).groupBy(F.col("span_id").alias("__of"))
            .agg(F.min(F.struct("seq", "us", "kind", "error_type", "error_message")).alias("__end")))
    own = chunks.join(ends, F.col("span_id").eqNullSafe(F.col("__of")), "left").drop("__of")
    own = own.where(end.isNull() | (F.col("seq") <= end["seq"]))
    token = (kind == "chunk") & (F.col("delta") != "")
    used = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c)
    stats = own.groupBy("span_id").agg(
        F.min("us").alias("started_us"), F.max("us").alias("__last"), F.min(F.when(token, F.col("us"))).alias("first_token_us"),
        used("prompt_tokens"), used("completion_tokens"), F.count_if(kind == "chunk").alias("chunk_count"), F.first("__end").alias("__end"))
    place = Window.partitionBy("span_id").orderBy("seq", "delta")
    head = (own.where(token & (end.isNull() | (F.col("seq") < end["seq"]))).select("span_id", "seq", "delta")
            .withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= max_chars))
    texts = head.groupBy(F.col("span_id").alias("__of")).agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("__head"))
    text = F.substring(F.array_join(F.transform("__head", lambda x: x["delta"]), ""), 1, max_chars)
    failed = end["kind"] == "error"
    return stats.join(texts, F.col("span_id").eqNullSafe(F.col("__of")), "left").select(
        "span_id", F.coalesce(*[F.when(end["kind"] == k, F.lit(v)) for k, v in END_KINDS.items()]).alias("status"),
        "started_us", F.coalesce(end["us"], "__last").alias("ended_us"), "first_token_us", "prompt_tokens", "completion_tokens",
        "chunk_count", F.coalesce(text, F.lit("")).alias("output_text"), F.when(failed, end["error_type"]).alias("error_type"),
        F.when(failed, end["error_message"]).alias("error_message"))


class SpanStore:
    """Open spans of a stream: their chunks by batch, and the spans that are gone.

    Each batch lands the rows of the spans it touched, made of all their chunks, so batches may bring them in any order.
    The watermark is the newest event time of earlier batches less ``delay_ms``; rows at or before that of the batch
    before are late and dropped.  A span idle for ``timeout_ms`` of event time goes with its chunks, with a TIMEOUT row
    unless it ended; a mark stays for the same time again, so that stragglers do not open it anew.  Every
    ``compact_every`` batches what is still open is gathered into one folder, so what is kept and read is bounded by
    the spans of the last ``timeout_ms``.

    Rows land below ``<root>/data/batch_id=<n>``: 2 k for batch k, 2 k + 1 for what expires after it.
    """

    def __init__(self, spark: SparkSession, root: str, timeout_ms: int, delay_ms: int, compact_every: int = 8):
        self.spark, self.root, self.timeout_ms, self.delay_ms, self.compact_every = spark, root, timeout_ms, delay_ms, compact_every
        self.manifest = Manifest(spark, f"{root}/spans")

    def _open(self, now: dict) -> DataFrame:
        """The chunks of spans that are not gone."""
        rows = _read(self.spark, now.get("chunks", []), T.StructType.fromDDL(f"{SPAN_CHUNK}, batch long, floor_ms long"))
        if not now.get("gone"):
            return rows
        gone = self._gone(now).select(F.col("span_id").alias("__of"), "gone_batch")
        return rows.join(gone, F.col("span_id").eqNullSafe(F.col("__of")) & (F.col("batch") <= F.col("gone_batch")), "left_anti")

    def _gone(self, now: dict) -> DataFrame:
        return _read(self.spark, now.get("gone", []), T.StructType.fromDDL("span_id string, gone_batch long, mark_ms long"))

    def _expired(self, chunks: DataFrame, at_ms: int, batch_id: int) -> DataFrame:
        """The spans whose timer is due: idle since their last event, or since the watermark of its batch if that was later."""
        timer = F.greatest(F.floor(F.max("us") / 1000) + F.lit(self.timeout_ms), F.max("floor_ms"))
        return (chunks.groupBy("span_id").agg(timer.alias("__timer"), F.max(F.col("kind").isin(*END_KINDS)).alias("ended"))
                .where(F.col("__timer") <= at_ms)
                .select("span_id", F.lit(batch_id).cast("long").alias("gone_batch"), (F.col("__timer") + F.lit(max(self.timeout_ms, 1))).alias("mark_ms"), "ended"))

    @staticmethod
    def _of(chunks: DataFrame, spans: DataFrame, how: str = "left_semi") -> DataFrame:
        return chunks.join(spans.select(F.col("span_id").alias("__of")), F.col("span_id").eqNullSafe(F.col("__of")), how)

    def _expire(self, idle: DataFrame, at_ms: int, batch_id: int, name: str) -> tuple[str, DataFrame]:
        """Lands the spans of ``idle`` chunks that are due; returns their folder and the TIMEOUT rows of those without an end."""
        to = f"{self.root}/spans/gone/{name}"
        due = self._expired(idle, at_ms, batch_id)
        due.write.mode("overwrite").parquet(to)
        due = self.spark.read.schema(due.schema).parquet(to)
        return to, span_rows(self._of(idle, due.where(~F.coalesce("ended", F.lit(False))))).withColumn("status", F.lit("TIMEOUT"))

    def _land(self, rows: DataFrame, number: int) -> None:
        rows.withColumn("batch_id", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.root}/data/batch_id={number}")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one batch of chunk rows; all of it or nothing becomes visible to later batches, by one switch."""
        now = self.manifest.read()
        if batch_id <= now["batch"]:
            return
        late, mark = now.get("used_ms", 0), now.get("watermark_ms", 0)
        own = self.spark = batch.sparkSession
        newest = batch.agg(F.max("us")).first()[0]
        rows = batch.where(F.col("us") > F.lit(late) * F.lit(1000))
        if now.get("gone"):
            rows = self._of(rows, self._gone(now).where(F.col("mark_ms") > late), "left_anti")
        to = f"{self.root}/spans/chunks/batch_id={batch_id}"
        rows = rows.withColumns({"batch": F.lit(batch_id).cast("long"), "floor_ms": F.lit(mark + 1).cast("long")})
        rows.write.mode("overwrite").parquet(to)
        rows = own.read.schema(T.StructType.fromDDL(f"{SPAN_CHUNK}, batch long, floor_ms long")).parquet(to)
        new = {**now, "batch": batch_id, "chunks": [*now.get("chunks", []), to], "used_ms": mark,
               "watermark_ms": max(mark, mark if newest is None else newest // 1000 - self.delay_ms)}
        out = rows
        if now.get("chunks"):
            touched, before = rows.select("span_id").distinct(), self._open(now)
            out = self._of(before, touched).unionByName(rows)
            if mark > late:
                folder, timeouts = self._expire(self._of(before, touched, "left_anti"), mark, batch_id, f"batch_id={batch_id}")
                new["gone"] = [*now.get("gone", []), folder]
                out = span_rows(out).unionByName(timeouts)
                self._land(out, 2 * batch_id)
                out = None
        if out is not None:
            self._land(span_rows(out), 2 * batch_id)
        new = self.manifest.switch(new)
        if len(new["chunks"]) >= self.compact_every:
            self.compact()

    def expire(self) -> None:
        """Let go of what the newest watermark finds idle; for times when no batch runs, as at the end of the input."""
        now = self.manifest.read()
        mark = now.get("watermark_ms", 0)
        if mark == now.get("used_ms", 0):
            return
        folder, timeouts = self._expire(self._open(now), mark, now["batch"], f"after={now['batch']}")
        self._land(timeouts, 2 * now["batch"] + 1)
        self.manifest.switch({**now, "used_ms": mark, "gone": [*now.get("gone", []), folder]})

    def compact(self) -> None:
        """Gather the open chunks into one folder and the marks that still count into another."""
        now = self.manifest.read()
        to, told = (f"{self.root}/spans/{kind}/version={now['version'] + 1}" for kind in ("chunks", "gone"))
        self._open(now).write.mode("overwrite").parquet(to)
        self._gone(now).where(F.col("mark_ms") > now.get("used_ms", 0)).write.mode("overwrite").parquet(told)
        self.manifest.switch({**now, "chunks": [to], "gone": [told]})
