"""Micro-batches cut by events inside files, and a restart from the middle of a file."""

import json
import os

from spanlake.session import scratch_path
from spanlake.sources.admission import START, JsonLineReader, stream_json_lines
from spanlake.sources.events import payloads_from_events
from spanlake.streaming import jobs as ST
from conftest import SMALL


def _put(folder, name, lines, when, last_end=True):
    os.makedirs(folder, exist_ok=True)
    tmp = f"{folder}/.{name}"
    with open(tmp, "w") as f:
        f.write("\n".join(lines) + ("\n" if last_end else ""))
    os.utime(tmp, (when, when))
    os.rename(tmp, f"{folder}/{name}")


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def _drain(reader):
    at, sizes, got = reader.initialOffset(), [], []
    while (end := reader.latestOffset()) != at:
        rows = [(r["line"], r["payload"]) for p in reader.partitions(at, end) for b in reader.read(p) for r in b.to_pylist()]
        sizes.append(len(rows))
        got += rows
        at = end
    return sizes, got, at


def test_offsets_inside_files(tmp_path):
    folder = str(tmp_path)
    long = "x" * (3 << 20)  # longer than what is read at a time
    _put(folder, "b", ["b%d" % i for i in range(5)], 100, last_end=False)
    _put(folder, "a", ["é", long, "", "a3\r"], 200)
    _put(folder, "empty", [], 150, last_end=False)
    opts = {"path": folder, "maxEvents": "3", "maxWaitMs": "0", "eventsPerTask": "2"}
    sizes, got, end = _drain(JsonLineReader(opts))
    assert sizes == [3, 3, 3]
    assert got == [(i, "b%d" % i) for i in range(5)] + [(0, "é"), (1, long), (2, ""), (3, "a3")]
    # a reader that starts anew is told the last offset before it is asked for the next
    again = JsonLineReader(opts)
    assert again.partitions(end, end) == [] and again.latestOffset() == end
    _put(folder, "c", ["later"], 300)
    new = again.latestOffset()
    assert [(p.path.rsplit("/", 1)[1], p.line, p.count) for p in again.partitions(end, new)] == [("c", 0, 1)]
    assert JsonLineReader({"path": folder + "/none"}).latestOffset() == START


def test_short_batch_waits_its_time(tmp_path, monkeypatch):
    from spanlake.sources import admission
    now = [0.0]
    monkeypatch.setattr(admission.time, "monotonic", lambda: now[0])
    folder = str(tmp_path)
    _put(folder, "a", ["1", "2"], 100)
    r = JsonLineReader({"path": folder})
    assert r.latestOffset() == START
    now[0] = 1.9
    assert r.latestOffset() == START
    now[0] = 2.0
    assert r.latestOffset()["line"] == 2
    _put(folder, "b", [str(i) for i in range(20)], 200)
    assert r.latestOffset()["line"] == 20  # a full batch does not wait


def test_job_cuts_batches_and_restarts_inside_a_file(spark):
    root = scratch_path(spark, "lines")
    folder = _local(root) + "/in"
    rows = payloads_from_events(spark.read.parquet(SMALL + "/events.parquet")).orderBy("event_id").limit(50).collect()
    _put(folder, "one.json", [r.payload for r in rows[:45]], 1000)
    payloads = stream_json_lines(spark, root + "/in", 20, max_wait_ms=60000)
    q = ST.start_ingest(payloads, spark, root + "/job", trigger={"processingTime": "0 seconds"})
    try:  # two full batches; five lines of the file are left waiting when the job is stopped
        q.processAllAvailable()
    finally:
        q.stop()
    raw = [spark.read.parquet(f"{root}/job/raw/batch_id={k}") for k in range(2)]
    assert [b.count() for b in raw] == [20, 20] and not os.path.exists(f"{_local(root)}/job/raw/batch_id=2")
    assert ST.ingested(payloads, spark, root + "/job")[1].count() == 40
    _put(folder, "two.json", [r.payload for r in rows[45:]] + ["{broken"], 2000)
    facts, life = ST.run_ingest_lines(spark, root + "/in", 20, root=root + "/job")
    assert life.count() == 51 and life.select("event_id").distinct().count() == 51
    want = {json.loads(r.payload)["id"] for r in rows if json.loads(r.payload)["latency_ms"] >= 0 and json.loads(r.payload)["status"] != "bogus"}
    assert {r.id for r in facts.select("id").collect()} == want
    assert life.where("error like 'malformed_json%'").count() == 1


def test_rules_are_planned_once_a_job(spark, monkeypatch):
    """Batches do not build the rules again, and each row runs through them once however often its batch is read."""
    root = scratch_path(spark, "lines-planned-once")
    local = root[len("file:"):] if root.startswith("file:") else root
    os.makedirs(local + "/in")
    with open(local + "/in/a.json", "w") as f:
        f.writelines(json.dumps({"id": f"0123456789-{k}"}) + "\n" for k in range(7))
    calls = []
    rules = ST.check_events
    monkeypatch.setattr(ST, "check_events", lambda *a, **k: calls.append(1) or rules(*a, **k))
    _, life = ST.run_ingest_lines(spark, root + "/in", max_events=2, root=root + "/job")
    assert life.count() == 7 and len(os.listdir(local + "/job/raw")) == 4
    assert len(calls) == 1


def test_a_full_batch_is_read_by_all_slots(spark):
    root = scratch_path(spark, "lines-spread")
    _put(_local(root) + "/in", "a.json", ["{}"] * 3000, 1000)
    tasks = []
    q = (stream_json_lines(spark, root + "/in", 3000, max_wait_ms=0).writeStream
         .foreachBatch(lambda b, i: tasks.append((b.rdd.getNumPartitions(), b.count())))
         .option("checkpointLocation", root + "/checkpoint").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert tasks == [(min(6, spark.sparkContext.defaultParallelism), 3000)]
