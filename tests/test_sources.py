import datetime as dt
import json
import os

from pyspark.sql import functions as F

from spanlake.operators.merge import purge_before
from spanlake.session import scratch_path
from spanlake.sources.events import bronze, read_json_events, write_bronze


def test_json_files_and_bronze_round_trip(spark):
    root = scratch_path(spark, "sources-test")
    local = root[len("file:"):] if root.startswith("file:") else root  # test writes input files directly
    os.makedirs(local + "/in", exist_ok=True)
    evs = [{"id": f"abcdefghij{i:02d}", "provider": "openai", "model": "gpt-4o", "status": "success",
            "started_at": "2024-01-0%dT00:00:00" % (i % 3 + 1), "ended_at": "2024-01-01T00:00:01",
            "latency_ms": 5, "request": {"prompt": "p"}} for i in range(6)]
    with open(local + "/in/part-0.json", "w") as f:
        f.write("\n".join(json.dumps(e) for e in evs[:3]) + "\n")
        f.write(json.dumps({"events": evs[3:]}) + "\n")
    single = read_json_events(spark, root + "/in")
    assert single.filter(F.col("e.id").isNotNull() & F.col("e._corrupt_record").isNull()).count() == 3
    batched = read_json_events(spark, root + "/in", batched=True)
    assert sorted(r[0] for r in batched.filter(F.col("e").isNotNull()).select("e.id").collect()) == \
        [e["id"] for e in evs[3:]]
    b = bronze(single.filter(F.col("e.id").isNotNull())
               .select("payload", F.to_timestamp("e.started_at").alias("received_at")))
    write_bronze(b, root + "/bronze")
    back = spark.read.parquet(root + "/bronze")
    assert sorted(r[0] for r in back.select("dt").distinct().collect()) == [dt.date(2024, 1, 1), dt.date(2024, 1, 2),
                                                                            dt.date(2024, 1, 3)]
    assert purge_before(back, dt.date(2024, 1, 2)).count() == 2
    assert set(back.select("event_status").distinct().toPandas()["event_status"]) == {"RECEIVED"}


def test_fact_table_partition_pruning(spark):
    from conftest import SMALL
    from spanlake.operators.metrics import summary
    from spanlake.sources.facts import read_facts, write_facts
    from spanlake.sources.fixtures import call_logs
    path = scratch_path(spark, "facts-test")
    logs = call_logs(spark, SMALL)
    write_facts(logs, path, files_per_day=2)
    facts = read_facts(spark, path)
    direct = summary(logs, "7d").collect()
    stored = summary(facts, "7d")
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "GreaterThanOrEqual(created_at" in plan
    assert stored.collect() == direct
