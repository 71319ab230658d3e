import datetime as dt

from pyspark.sql import functions as F

from conftest import SMALL
from spanlake.operators import cost as C
from spanlake.sources.prices import price_catalog
from spanlake.operators import ingest as I
from spanlake.operators import merge as MG
from spanlake.operators import validate as V
from spanlake.sources.events import drop_column, parse_batches, parse_events
from spanlake.sources.fixtures import call_logs


def test_upsert_mixed_first_last_write(spark):
    rows = [("a", 1, "SUCCESS", 10, 5, dt.datetime(2024, 1, 1)), ("a", 2, "ERROR", 99, None, dt.datetime(2024, 1, 2)),
            ("b", 3, "SUCCESS", 7, 1, dt.datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "id string, event_id long, status string, latency_ms int, "
                                     "prompt_tokens int, created_at timestamp_ntz")
    got = {r["id"]: r for r in MG.fold_latest(df).collect()}
    assert (got["a"]["status"], got["a"]["latency_ms"], got["a"]["prompt_tokens"], got["a"]["versions"]) == \
        ("ERROR", 10, None, 2)
    assert got["a"]["created_at"] == dt.datetime(2024, 1, 1)


def test_json_ingest_reasons(spark):
    good = ('{"id":"abcdefghij12","provider":"OpenAI","model":"gpt-4o","status":"SUCCESS",'
            '"started_at":"2024-01-01T00:00:00","ended_at":"2024-01-01T00:00:01","latency_ms":1000,'
            '"request":{"messages":[{"role":"user","content":"hi"},{"role":"user","content":"there"}]},'
            '"usage":{"prompt_tokens":0,"completion_tokens":0},"unknown_field":1}')
    bad = ('{"id":"short","provider":"x","model":"m","status":"weird","started_at":"nope",'
           '"ended_at":"2024-01-01T00:00:01","latency_ms":-5,"request":{"messages":[{"role":"user"}]}}')
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), good), (2, dt.datetime(2024, 1, 1), bad),
                                (3, dt.datetime(2024, 1, 1), "{not json")],
                               "event_id long, received_at timestamp_ntz, payload string")
    facts, life = I.ingest(parse_events(df))
    f = facts.collect()
    assert len(f) == 1
    assert (f[0]["provider"], f[0]["provider_raw"], f[0]["status"], f[0]["total_tokens"], f[0]["input_preview"],
            f[0]["environment"], f[0]["streamed"]) == ("OPENAI", "openai", "SUCCESS", None, "hi there", "dev", False)
    lc = {r["event_id"]: r for r in life.collect()}
    assert lc[1]["status"] == "PROCESSED"
    assert set(lc[2]["reject_reasons"]) >= {"id_too_short", "bad_started_at", "negative_latency_ms",
                                             "message_missing_field", "bad_status"}
    assert lc[3]["reject_reasons"][0] == "malformed_json" and lc[3]["status"] == "FAILED"


def test_batch_bodies(spark):
    body = '{"events":[{"id":"aaaaaaaaaa01","provider":"google"},{"id":"aaaaaaaaaa02","provider":"ollama"}]}'
    df = spark.createDataFrame([(body,)], "payload string")
    out = parse_batches(df).select("batch_pos", "e.id").collect()
    assert [(r[0], r[1]) for r in out] == [(0, "aaaaaaaaaa01"), (1, "aaaaaaaaaa02")]


def test_reject_report_and_split(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (None, 3)], "id long, latency_ms int")
    rules = V.required("id") + [("negative_latency_ms", F.col("latency_ms") >= 0)]
    checked = V.with_reasons(df, rules)
    ok, rej = V.split_valid(checked)
    assert ok.count() == 1 and rej.count() == 2
    rep = {r["reason"]: r["rows"] for r in V.reject_report(checked).collect()}
    assert rep == {"accepted": 1, "negative_latency_ms": 1, "missing_id": 1}


def test_backfill_modes(spark):
    logs = call_logs(spark, SMALL, previews=True)
    ref = C.backfill_tokens(logs, "reference")
    fill = C.backfill_tokens(logs, "fill")
    assert ref.filter((F.col("provider") == "OTHER") & F.col("prompt_tokens").isNull()).count() == 0
    before = logs.filter((F.col("provider_raw") == "ollama") & F.col("prompt_tokens").isNotNull()).select(
        "id", "prompt_tokens").orderBy("id").collect()
    after = fill.join(logs.filter((F.col("provider_raw") == "ollama") & F.col("prompt_tokens").isNotNull())
                      .select("id"), "id").select("id", "prompt_tokens").orderBy("id").collect()
    assert before == after


def test_orphans_and_cascade(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id long, parent long")
    parent = spark.createDataFrame([(10,)], "pid long")
    assert [r["id"] for r in MG.orphans(child, parent, "parent", "pid").collect()] == [2]
    assert [r["id"] for r in MG.keep_with_parent(child, parent, "parent", "pid").collect()] == [1]


def test_drop_column_idempotent(spark):
    df = spark.createDataFrame([(1, "x")], "a int, content_redacted string")
    once = drop_column(df, "content_redacted")
    assert drop_column(once, "content_redacted").columns == ["a"]


def test_catalog_join_equals_literal_lookup(spark):
    from spanlake.sources.prices import price_catalog
    logs = call_logs(spark, SMALL)
    a = C.cost_by_model(logs).orderBy("provider_raw", "model").collect()
    b = C.cost_by_model(logs, price_catalog(spark)).orderBy("provider_raw", "model").collect()
    assert a == b


def test_fold_state_is_refoldable(spark):
    from conftest import SMALL
    from spanlake.sources.fixtures import raw_events
    r = raw_events(spark, SMALL).select("id", "event_id", "status", "latency_ms", "prompt_tokens",
                                        F.col("received_at").alias("created_at"))
    direct = sorted(tuple(x) for x in MG.fold_latest(r, mutable=("status", "prompt_tokens")).collect())
    a, b = r.filter(F.col("event_id") % 2 == 0), r.filter(F.col("event_id") % 2 == 1)
    st = MG.fold_state(a, mutable=("status", "prompt_tokens")).unionByName(
        MG.fold_state(b, mutable=("status", "prompt_tokens")))
    merged = MG.state_rows(MG.merge_states(st)).select(*MG.fold_latest(r, mutable=("status", "prompt_tokens")).columns)
    assert sorted(tuple(x) for x in merged.collect()) == direct


def test_compact_snapshot(spark):
    from conftest import SMALL
    from spanlake.session import scratch_path
    from spanlake.sources.fixtures import raw_events
    root = scratch_path(spark, "compact-test")
    r = raw_events(spark, SMALL).select("id", "event_id", "status", F.col("received_at").alias("created_at"))
    r.withColumn("batch_id", (F.col("event_id") % 3).cast("long")).write.partitionBy("batch_id").parquet(root + "/log")
    MG.compact(spark, root + "/log", None, root + "/snap1", mutable=("status",))
    got = sorted(tuple(x) for x in MG.state_rows(spark.read.parquet(root + "/snap1")).select(
        "id", "event_id", "status", "created_at", "versions").collect())
    want = sorted(tuple(x) for x in MG.fold_latest(r, mutable=("status",)).select(
        "id", "event_id", "status", "created_at", "versions").collect())
    assert got == want


def test_repeated_price_keys_do_not_multiply_calls(spark):
    prices = price_catalog(spark)
    logs = spark.createDataFrame([("a", "openai", "gpt-4o", 1000, 500)], "id string, provider_raw string, model string, prompt_tokens int, completion_tokens int")
    once, twice = C.join_prices(logs, prices).collect(), C.join_prices(logs, prices.unionByName(prices)).collect()
    assert once == twice and len(once) == 1 and once[0]["cost_usd"] is not None


def test_ingest_redacts_before_storing(spark):
    import json

    from spanlake.operators.ingest import ingest
    from spanlake.sources.events import parse_events
    body = {"id": "0123456789ab", "provider": "openai", "model": "m", "latency_ms": 5, "status": "success",
            "started_at": "2024-01-01T00:00:00Z", "ended_at": "2024-01-01T00:00:01Z",
            "request": {"messages": [{"role": "user", "content": "mail a@b.co", "name": "bob@x.com"}], "prompt": "ssn 123-45-6789",
                        "extra": {"k": "call 555-123-4567"}}, "response": {"content": "ip 10.0.0.1"}}
    rows = [(1, json.dumps(body)), (2, "broken {")]
    raw = parse_events(spark.createDataFrame(rows, "event_id long, payload string").selectExpr("*", "timestamp_ntz'2024-01-01' as received_at"))
    facts, life = ingest(raw)
    stored = facts.collect()
    assert len(stored) <= 1 and life.count() == 2
    checked = ingest(raw, redact=False)[0].collect()
    assert len(checked) == len(stored) == 1, life.collect()
    text = str(stored[0])
    assert not any(x in text for x in ("a@b.co", "bob@x.com", "123-45-6789", "555-123-4567", "10.0.0.1"))
    assert {d["type"]: d["count"] for d in json.loads(stored[0]["pii_detections"])} == {"email": 2, "phone": 1, "ssn": 1, "ipv4": 1}
    assert stored[0]["input_preview"] == "mail [REDACTED_EMAIL]"


def test_redaction_keeps_shape_and_appends_per_part(spark):
    """NULL elements, missing parts and separators survive; request findings come before the response's."""
    import json

    from spanlake.operators.ingest import redact_events
    from spanlake.sources.events import parse_events
    own = [{"request": {"messages": [{"role": "user", "content": None}, None, {"role": "a@b.co", "content": "&\u0001& a\u0001b c@d.co"}],
                        "extra": {"x": None, "m@n.co": "p 555-123-4567"}}, "response": {"content": "c@d.co and e@f.co"}},
           {"request": {"prompt": "plain"}}, {"response": {"content": None, "finish_reason": "stop"}},
           {"request": {"messages": []}, "response": {"content": "10.0.0.1"}, "pii_detections": [{"type": "ssn", "count": 9}]}]
    rows = [(i, json.dumps(x)) for i, x in enumerate(own)] + [(9, "broken {")]
    raw = parse_events(spark.createDataFrame(rows, "event_id long, payload string").selectExpr("*", "timestamp_ntz'2024-01-01' as received_at"))
    got = {r.event_id: r.e for r in redact_events(raw).collect()}
    before = {r.event_id: r.e for r in raw.collect()}
    assert len(got) == 5
    m = got[0].request.messages
    assert [None if x is None else (x.role, x.content) for x in m] == [
        ("user", None), None, ("[REDACTED_EMAIL]", "&\u0001& a\u0001b [REDACTED_EMAIL]")]
    assert got[0].request.extra == {"x": None, "m@n.co": "p [REDACTED_PHONE]"}
    assert got[0].response.content == "[REDACTED_EMAIL] and [REDACTED_EMAIL]"
    assert [(d.type, d["count"]) for d in got[0].pii_detections] == [("email", 2), ("phone", 1), ("email", 2)]
    assert got[1] == before[1] and got[2] == before[2]
    assert [(d.type, d["count"]) for d in got[3].pii_detections] == [("ssn", 9), ("ipv4", 1)]
