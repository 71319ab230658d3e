"""A stream of JSON lines cut into micro-batches by events, not by files.

Spark's file source admits whole files; here the offset is a place inside a file, so a batch ends after
``maxEvents`` lines (20) or, when fewer have come, once the oldest of them has waited ``maxWaitMs`` (2000 ms).
Files are taken in order of (modification time, path).  They are delivered whole, by a rename, and none appears later
with a smaller place in that order than a file already begun; a last line without a line end is a line.

The planner reads the lines of the next batch once to find its end, tasks read them again from there; nothing but
offsets passes through the driver.  ``maxEvents`` bounds that work, and a batch of more than ``eventsPerTask`` lines
is read by several tasks.  An offset is ``(modification time, path, byte, line)``, so a stream stopped in the middle of
a file goes on at the next line.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SOURCE = "json_line_events"
SCHEMA = "file string, line long, modified_us long, payload string"
LEAST_PER_TASK = 500  # lines that are worth a task
START = {"mtime": -1, "path": "", "byte": 0, "line": 0}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if urlsplit(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlsplit(path).path
    return pafs.FileSystem.from_uri(path)


def _lines(fs: pafs.FileSystem, path: str, start: int) -> Iterator[bytes]:
    """The lines of a file from a byte on, line ends included."""
    with fs.open_input_file(path) as raw:
        raw.seek(start)
        rest = b""
        while chunk := raw.read(1 << 20):
            # a line longer than a chunk is joined once, at its end
            pieces = chunk.split(b"\n")
            if len(pieces) == 1:
                rest += chunk
                continue
            yield rest + pieces[0] + b"\n"
            for p in pieces[1:-1]:
                yield p + b"\n"
            rest = pieces[-1]
        if rest:
            yield rest


class Stretch(InputPartition):
    """``count`` lines of one file from a byte on."""

    def __init__(self, path: str, mtime: int, byte: int, line: int, count: int):
        self.path, self.mtime, self.byte, self.line, self.count = path, mtime, byte, line, count


class JsonLineReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.max_events = int(options.get("maxEvents", 20))
        self.max_wait_ms = int(options.get("maxWaitMs", 2000))
        self.per_task = int(options.get("eventsPerTask", 10000))
        self.fs, self.folder = _open(self.path)
        self.at: dict | None = None
        self.waiting: tuple | None = None
        if self.max_events < 1 or self.per_task < 1:
            raise ValueError("maxEvents and eventsPerTask must be at least 1")

    def initialOffset(self) -> dict:
        return dict(START)

    def _files(self, start: dict) -> list[tuple[int, str]]:
        """Files from the one the offset lies in on."""
        found = self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True))
        names = ((int(f.mtime_ns or 0), f.path) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))
        return sorted(n for n in names if n >= (start["mtime"], start["path"]))

    def _walk(self, start: dict, limit: int, end: dict | None = None) -> Iterator[tuple[Stretch, dict]]:
        """The stretches of at most ``limit`` lines (or up to ``end``) after ``start``, each with the offset after it."""
        for mtime, path in self._files(start):
            own = (mtime, path) == (start["mtime"], start["path"])
            byte, line = (start["byte"], start["line"]) if own else (0, 0)
            if end is not None and (mtime, path) > (end["mtime"], end["path"]):
                return
            stop = end["line"] if end is not None and (mtime, path) == (end["mtime"], end["path"]) else None
            first, count, size = (byte, line), 0, byte
            for text in _lines(self.fs, path, byte):
                if limit == 0 or (stop is not None and first[1] + count >= stop):
                    break
                count, size, limit = count + 1, size + len(text), limit - 1
                if count == self.per_task:
                    now = {"mtime": mtime, "path": path, "byte": size, "line": first[1] + count}
                    yield Stretch(path, mtime, *first, count), now
                    first, count = (size, first[1] + count), 0
            if count:
                yield Stretch(path, mtime, *first, count), {"mtime": mtime, "path": path, "byte": size, "line": first[1] + count}
            if limit == 0:
                return

    def latestOffset(self) -> dict:
        start = self.at or dict(START)
        end, events = start, 0
        for stretch, now in self._walk(start, self.max_events):
            end, events = now, events + stretch.count
        if 0 < events < self.max_events and self.max_wait_ms > 0:
            place = tuple(start.values())
            if self.waiting is None or self.waiting[0] != place:
                self.waiting = (place, time.monotonic())
            if (time.monotonic() - self.waiting[1]) * 1000 < self.max_wait_ms:
                return start
        self.at = end
        return end

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        # a restarted query names the last offset it knows here before it asks for a newer one
        self.at = end
        return [] if start == end else [s for s, _ in self._walk(start, 1 << 62, end)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        rows: list[tuple[int, str]] = []

        def batch() -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * n, pa.string()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([partition.mtime // 1000] * n, pa.int64()), pa.array([r[1] for r in rows], pa.string())],
                ["file", "line", "modified_us", "payload"])
        for k, text in enumerate(_lines(fs, partition.path, partition.byte)):
            if k == partition.count:
                break
            rows.append((partition.line + k, text.rstrip(b"\r\n").decode("utf-8", "replace")))
            if len(rows) == 1000:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


class JsonLineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> JsonLineReader:
        return JsonLineReader(self.options)


def stream_json_lines(spark: SparkSession, path: str, max_events: int = 20, max_wait_ms: int = 2000) -> DataFrame:
    """``event_id, received_at, payload`` of JSON lines, ready for an ingest job, at most ``max_events`` a micro-batch.

    ``event_id`` is a hash of the file and the line's place, so a batch that runs again keeps its ids;
    ``received_at`` is the file's modification time.  A full batch is read, and checked, by all task slots.
    """
    spark.dataSource.register(JsonLineSource)
    per_task = max(LEAST_PER_TASK, -(-max_events // max(1, spark.sparkContext.defaultParallelism)))
    raw = (spark.readStream.format(SOURCE).option("maxEvents", str(max_events)).option("maxWaitMs", str(max_wait_ms))
           .option("eventsPerTask", str(per_task)).load(path))
    return raw.select(F.xxhash64("file", "line").alias("event_id"),
                      F.timestamp_micros("modified_us").cast("timestamp_ntz").alias("received_at"), "payload")
