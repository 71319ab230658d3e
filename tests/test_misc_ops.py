import datetime as dt

from pyspark.sql import functions as F

from conftest import SMALL
from spanlake.operators import conversations as CV
from spanlake.operators import merge as MG
from spanlake.operators import metrics as M
from spanlake.operators.spans import span_payloads
from spanlake.sources.fixtures import call_logs
from spanlake.streaming import jobs as ST

T0 = dt.datetime(2024, 1, 1)


def test_mark_processed_and_stuck(spark):
    ev = spark.createDataFrame([(1, T0), (2, T0), (3, T0 + dt.timedelta(days=2))],
                               "event_id long, received_at timestamp_ntz")
    facts = spark.createDataFrame([(1, "a")], "event_id long, id string")
    st = {r["event_id"]: r["status"] for r in MG.mark_processed(ev, facts).collect()}
    assert st == {1: "PROCESSED", 2: "RECEIVED", 3: "RECEIVED"}
    stuck = MG.stuck_events(MG.mark_processed(ev, facts), T0 + dt.timedelta(days=3), dt.timedelta(days=2))
    assert [r["event_id"] for r in stuck.collect()] == [2]


def test_archive_touch_purge(spark):
    convs = spark.createDataFrame([(1, "ACTIVE", T0), (2, "ACTIVE", T0)],
                                  "conversation_id long, status string, updated_at timestamp_ntz")
    ids = spark.createDataFrame([(2,)], "conversation_id long")
    a = {r["conversation_id"]: (r["status"], r["updated_at"]) for r in
         MG.archive(convs, ids, T0 + dt.timedelta(days=1)).collect()}
    assert a == {1: ("ACTIVE", T0), 2: ("ARCHIVED", T0 + dt.timedelta(days=1))}
    listed = CV.list_conversations(MG.archive(convs, ids, T0)).collect()
    assert [r["conversation_id"] for r in listed] == [1]
    msgs = spark.createDataFrame([(1, T0 + dt.timedelta(hours=5))], "conversation_id long, created_at timestamp_ntz")
    t = {r["conversation_id"]: r["updated_at"] for r in MG.touch(convs, msgs).collect()}
    assert t == {1: T0 + dt.timedelta(hours=5), 2: T0}
    part = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 2, 1),)], "dt date")
    assert MG.purge_before(part, dt.date(2024, 1, 15)).count() == 1


def test_message_log_links_and_title(spark):
    msgs = spark.createDataFrame([("m1", "x" * 36), ("m2", None)], "id string, inference_log_id string")
    logs = spark.createDataFrame([("x" * 36, "SUCCESS", 5)], "id string, status string, latency_ms int")
    j = {r["id"]: r["log_status"] for r in CV.message_log_links(msgs.withColumnRenamed("id", "mid")
                                                                .withColumnRenamed("mid", "id"), logs).collect()}
    assert j == {"m1": "SUCCESS", "m2": None}
    df = spark.createDataFrame([("a" * 70, "openai", "0" * 26), ("", "ollama", "1" * 36)],
                               "m string, p string, l string")
    got = [tuple(r) for r in df.select(CV.title_from_message("m"), CV.chat_provider("p"),
                                       CV.assistant_log_link("l")).collect()]
    assert got == [("a" * 60, "OPENAI", None), ("New conversation", None, "1" * 36)]


def test_span_payload_metadata_merge(spark):
    spans = spark.createDataFrame([("s", "out")], "span_id string, output_text string")
    ctx = spark.createDataFrame([("s", {"env": "dev", "a": "1"}, {"a": "2"})],
                                "span_id string, default_metadata map<string,string>, metadata map<string,string>")
    r = span_payloads(spans, ctx).collect()[0]
    assert r["metadata"] == {"env": "dev", "a": "2"} and r["response"]["content"] == "out"


def test_stream_series_and_live_feed_equal_batch(spark):
    logs = call_logs(spark, SMALL)
    b = sorted(tuple(r) for r in M.timeseries(logs, "requests", "7d", "provider").collect())
    s = sorted(tuple(r) for r in ST.run_series(spark, SMALL, "7d", "provider").select("t", "series_key", "v").collect())
    assert b == s
    from spanlake.operators.reports import live_feed
    assert [r["id"] for r in live_feed(logs, 10).collect()] == [r["id"] for r in ST.run_live_feed(spark, SMALL, 10).collect()]


def test_processing_time_trigger_starts_and_stops(spark):
    stream = ST.table_stream(spark, SMALL, max_files_per_trigger=1).select("event_id")
    q, _ = ST.start(stream, spark, "l5-test", trigger={"processingTime": "2 seconds"})
    try:
        q.processAllAvailable()
        assert q.isActive
    finally:
        q.stop()


def test_apply_chat_turns(spark):
    convs = spark.createDataFrame([("c1", "Old", "ACTIVE", None, None, T0, T0)],
                                  "conversation_id string, title string, status string, provider string, "
                                  "model string, created_at timestamp_ntz, updated_at timestamp_ntz")
    msgs = spark.createDataFrame([("c1", "USER", "hi", None, T0)],
                                 "conversation_id string, role string, content string, inference_log_id string, "
                                 "created_at timestamp_ntz")
    t1, t2 = T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2)
    turns = spark.createDataFrame([
        ("t1", "c1", "again", "openai", "gpt-4o", "answer", "x" * 26, t1),
        ("t2", None, "q" * 70, "ollama", "llama3.2", "", "y" * 36, t2)],
        "turn_id string, conversation_id string, message string, provider string, model string, "
        "response string, log_id string, ts timestamp_ntz")
    c, m = CV.apply_chat_turns(convs, msgs, turns)
    cs = {r["conversation_id"]: r for r in c.collect()}
    assert cs["c1"]["updated_at"] == t1 and cs["c1"]["title"] == "Old"
    assert cs["t2"]["title"] == "q" * 60 and cs["t2"]["provider"] is None and cs["t2"]["updated_at"] == t2
    rows = sorted((r["conversation_id"], r["role"], r["content"], r["inference_log_id"]) for r in m.collect())
    assert rows == [("c1", "ASSISTANT", "answer", None), ("c1", "USER", "again", None), ("c1", "USER", "hi", None),
                    ("t2", "USER", "q" * 70, None)]


def test_scale_settings():
    from spanlake.session import scale_settings
    s = scale_settings(100 * (1 << 40), 8000)  # 100 TiB on 1000 x 8 cores
    assert int(s["spark.sql.shuffle.partitions"]) == 409600
    assert scale_settings(1 << 20, 8)["spark.sql.shuffle.partitions"] == "16"
