import datetime as dt

from conftest import SMALL
from spanlake.operators.spans import assemble_spans
from spanlake.sources.fixtures import call_logs, chunk_events
from spanlake.streaming import jobs as ST


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "span_id string, seq long, ts timestamp_ntz, delta string, "
                                       "prompt_tokens int, completion_tokens int, kind string")


def test_span_rules(spark):
    t = dt.datetime(2024, 1, 1)
    ms = lambda n: t + dt.timedelta(milliseconds=n)
    rows = [("s", 1, ms(0), "", None, None, "chunk"), ("s", 2, ms(150), "Hel", 10, None, "chunk"),
            ("s", 3, ms(200), "lo", None, 3, "chunk"), ("s", 4, ms(300), "", None, 5, "chunk"),
            ("s", 5, ms(400), None, None, None, "cancelled"), ("s", 6, ms(900), "late", 99, 99, "chunk"),
            ("s", 7, ms(950), None, None, None, "end")]
    r = assemble_spans(_chunks(spark, rows)).collect()[0]
    assert (r["status"], r["ttft_ms"], r["latency_ms"], r["output_text"], r["prompt_tokens"],
            r["completion_tokens"], r["total_tokens"]) == ("CANCELLED", 150, 400, "Hello", 10, 5, 15)


def test_span_output_cut_and_timeout(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("s", i, t + dt.timedelta(seconds=i), "ab", None, None, "chunk") for i in range(1500)]
    r = assemble_spans(_chunks(spark, rows), timeout=dt.timedelta(hours=1),
                       as_of=dt.datetime(2024, 1, 2)).collect()[0]
    assert r["output_text"] == "ab" * 1024 and r["status"] == "TIMEOUT"


def test_stream_spans_equal_batch(spark):
    batch = sorted(tuple(r) for r in assemble_spans(chunk_events(spark, SMALL)).collect())
    stream = sorted(tuple(r) for r in ST.run_spans(spark, SMALL, timeout=dt.timedelta(days=365)).collect())
    assert batch == stream


def test_stream_rollup_equal_batch(spark):
    from spanlake.operators.rollup import rollup
    cols = ["bucket", "provider", "model", "count_total", "count_error", "sum_cost_usd"]
    b = sorted(tuple(r) for r in rollup(call_logs(spark, SMALL)).select(*cols).collect())
    s = sorted(tuple(r) for r in ST.run_rollup(spark, SMALL).select(*cols).collect())
    assert b == s


def test_stream_upsert_twice_is_idempotent(spark):
    a = sorted(tuple(r) for r in ST.run_upsert(spark, SMALL)[0].drop("metadata").collect())
    b = sorted(tuple(r) for r in ST.run_upsert(spark, SMALL)[0].drop("metadata").collect())
    assert a == b and len(a) > 0


def test_stream_upsert_suppresses_duplicate_delivery(spark):
    import shutil

    from spanlake.session import scratch_path
    root = scratch_path(spark, "dup-input")
    local = root[len("file:"):] if root.startswith("file:") else root
    import os
    os.makedirs(local)
    for name in ("events.parquet", "events_again.parquet"):  # the same file delivered twice
        shutil.copyfile(SMALL + "/events.parquet", os.path.join(local, name))
    once_f, once_l = ST.run_upsert(spark, SMALL)
    twice_f, twice_l = ST.run_upsert(spark, local, glob="events*.parquet")
    assert sorted(tuple(r) for r in once_f.drop("metadata").collect()) == \
        sorted(tuple(r) for r in twice_f.drop("metadata").collect())
    assert twice_l.count() == once_l.count()


def test_stream_spans_timeout_matches_batch_cutoff(spark):
    from spanlake.session import scratch_path
    from spanlake.sources.fixtures import chunks_from_events
    # events-shaped fixture without error events: spans end only by going idle
    t0 = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for user, last_day in ((1, 0), (2, 1), (3, 5), (4, 6)):
        for k in range(5):
            rows.append((eid, t0 + dt.timedelta(days=last_day, minutes=k), user, "click" if k % 2 else "view",
                         1.0, "{}"))
            eid += 1
    root = scratch_path(spark, "timeout-fixture")
    (spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                 "value double, props string")
     .coalesce(1).write.parquet(root + "/staging"))
    import glob
    import os
    import shutil
    local = root[len("file:"):] if root.startswith("file:") else root
    part = glob.glob(local + "/staging/part-*.parquet")[0]
    shutil.copyfile(part, os.path.join(local, "events.parquet"))
    day = dt.timedelta(days=1)
    stream = {r["span_id"]: r["status"] for r in ST.run_spans(spark, local, timeout=day, watermark="10 minutes")
              .collect()}
    max_ts = max(r[1] for r in rows)
    chunks = chunks_from_events(spark.read.parquet(local + "/events.parquet"))
    batch = {r["span_id"]: r["status"] for r in
             assemble_spans(chunks, timeout=day + dt.timedelta(minutes=10), as_of=max_ts).collect()}
    assert batch == {"1": "TIMEOUT", "2": "TIMEOUT", "3": "SUCCESS", "4": "SUCCESS"}
    assert stream == batch


def _late_files(spark, name, parts=3):
    """The small events table in ``parts`` files by time, the newest delivered first."""
    import glob
    import os
    import shutil

    from pyspark.sql import functions as F
    from spanlake.session import scratch_path
    root = scratch_path(spark, name)
    local = root[len("file:"):] if root.startswith("file:") else root
    ev = spark.read.parquet(SMALL + "/events.parquet")
    edges = ev.select(F.expr("percentile(unix_micros(cast(ts as timestamp)), array(0.33, 0.66))")).first()[0]
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = [micros <= edges[0], (micros > edges[0]) & (micros <= edges[1]), micros > edges[1]]
    os.makedirs(local + "/in")
    for k, cut in enumerate(reversed(cuts)):
        ev.where(cut).coalesce(1).write.parquet(f"{root}/staging{k}")
        to = f"{local}/in/events{k}.parquet"
        shutil.copyfile(glob.glob(f"{local}/staging{k}/part-*.parquet")[0], to)
        os.utime(to, (1000 + k, 1000 + k))
    return root, local


def test_late_files_lose_nothing_and_a_restart_goes_on(spark):
    import os
    import shutil
    root, local = _late_files(spark, "late-input")
    os.makedirs(local + "/first")
    shutil.copyfile(local + "/in/events0.parquet", local + "/first/events0.parquet")
    want_f, want_l = ST.run_upsert(spark, SMALL)
    some, _ = ST.run_upsert(spark, local + "/first", glob="events*.parquet", root=root + "/job")
    assert 0 < some.count() < want_f.count()
    for k in (1, 2):  # older events arrive after the job was stopped
        shutil.copyfile(f"{local}/in/events{k}.parquet", f"{local}/first/events{k}.parquet")
    got_f, got_l = ST.run_upsert(spark, local + "/first", glob="events*.parquet", root=root + "/job", max_files_per_trigger=1)
    assert sorted(map(str, got_f.drop("metadata").collect())) == sorted(map(str, want_f.drop("metadata").collect()))
    assert sorted(map(str, got_l.collect())) == sorted(map(str, want_l.collect()))
    assert len(os.listdir(local + "/job/raw")) == 3  # one batch of audit rows per file


def test_late_files_in_rollup_and_series(spark):
    root, local = _late_files(spark, "late-aggregates")
    for job in (ST.run_rollup, ST.run_series):
        want = sorted(map(str, job(spark, SMALL).collect()))
        got = sorted(map(str, job(spark, local + "/in", glob="events*.parquet", max_files_per_trigger=1).collect()))
        assert got == want and want


def test_span_batches_time_out_revive_and_ignore_stragglers(spark):
    import os
    import tempfile

    from spanlake.streaming.stores import span_rows
    local, day, minute = tempfile.mkdtemp(prefix="span-batches-"), dt.timedelta(days=1), dt.timedelta(minutes=1)
    at = lambda days, minutes=0: dt.datetime(2024, 1, 1) + days * day + minutes * minute
    batches = [[("idle", 1, at(0), "a", "chunk"), ("failed", 2, at(0), "b", "chunk"), ("failed", 3, at(0), None, "error"), (None, 4, at(0), "n", "chunk"),
                ("revived", 5, at(0), "r", "chunk")],
               [("late end", 7, at(1.5), "e", "chunk")],
               [("revived", 6, at(1.5, -5), "s", "chunk"), ("new", 8, at(1.5, 1), "", "chunk")],
               [("idle", 9, at(1.5, 2), "x", "chunk"), ("failed", 10, at(1.5, 2), "x", "end"), ("too late", 11, at(0.5), "x", "chunk"),
                ("late end", 6, at(1.5, 1), None, "cancelled")]]
    for k, rows in enumerate(batches):
        path = f"{local}/events{k}.parquet"
        rows = [(s, q, t, d, None, None, kind) for s, q, t, d, kind in rows]
        _chunks(spark, rows).toPandas().astype({"prompt_tokens": "Int32", "completion_tokens": "Int32"}).to_parquet(path, coerce_timestamps="us", index=False)
        os.utime(path, (1000 + k, 1000 + k))
    for every in (2, 8):
        got = {r.span_id: (r.status, r.chunk_count, r.output_text) for r in ST.run_spans(
            spark, local, timeout=day, chunks=lambda c: c, glob="events*.parquet", max_files_per_trigger=1, compact_every=every).collect()}
        assert got == {"idle": ("TIMEOUT", 1, "a"), "failed": ("ERROR", 1, "b"), None: ("TIMEOUT", 1, "n"), "revived": ("SUCCESS", 2, "rs"),
                       "late end": ("CANCELLED", 0, ""), "new": ("SUCCESS", 1, "")}
    # spans are made by aggregates, not one by one in Python
    plan = span_rows(spark.createDataFrame([], ST.SPAN_CHUNK))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
