"""Point lookups open one folder and skip row groups; the derived rows reach every branch of PII, URL and model rules."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMALL
from spanlake.functions.pii import PII_TYPES
from spanlake.functions.urls import MODEL_FAMILY_PREFIXES
from spanlake.session import scratch_path
from spanlake.sources.facts import find_by_id, write_by_id


def _scan(df):
    """The file scan of an executed plan without adaptive parts, and the rows it read."""
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().head()
    return node


def test_lookup_prunes_folders_and_row_groups(spark):
    path = scratch_path(spark, "by-id")
    rows = spark.range(40000).select(F.concat(F.lit("evt-"), F.lpad((F.col("id") * 2).cast("string"), 8, "0")).alias("id"),
                                     F.sha2(F.col("id").cast("string"), 512).alias("request_payload"))
    write_by_id(rows.where("request_payload < '8'"), path, buckets=2, row_group_bytes=1 << 18)
    write_by_id(rows.where("request_payload >= '8'"), path, buckets=4, row_group_bytes=1 << 18)  # a later batch in more folders
    write_by_id(spark.createDataFrame([(None, "x")], "id string, request_payload string"), path, buckets=4)
    df = find_by_id(spark, path, "evt-00000042")
    assert [r.id for r in df.collect()] == ["evt-00000042"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,evt-00000042)]" in plan and "PartitionFilters: [isnotnull(id_bucket" in plan
    scan = _scan(df)
    assert scan.metrics().apply("numFiles").value() <= 3
    assert 1 <= scan.metrics().apply("numOutputRows").value() < 6000
    for absent in ("evt-00000043", "evt-00040001", "evt-00079997"):  # between ids of the table: the Bloom filter has to tell
        none = find_by_id(spark, path, absent)
        assert none.collect() == []
        assert _scan(none).metrics().apply("numOutputRows").value() == 0


def test_every_branch_is_reached(spark):
    q = E.queries()
    sums = q["pii_types_docs"](spark, SMALL).agg(*[F.sum(f"pii_{n}").alias(n) for n in PII_TYPES]).first()
    assert all(sums[n] > 0 for n in PII_TYPES), sums
    urls = q["classify_url_forms"](spark, SMALL).collect()
    assert {r.provider for r in urls} == {"openai", "anthropic", "google", "bedrock", "openai_compatible"}
    assert {r.client_provider for r in urls} == {"openai", "ollama", "openai_compatible"}
    assert {"eu-west-1", "ap-south-1", "us-east-1", "us-west-2", "eu-central-1", "sa-east-1", None} <= {r.bedrock_region for r in urls}
    families = {r.family for r in q["model_family_ids"](spark, SMALL).collect()}
    assert families == {f for _, f in MODEL_FAMILY_PREFIXES} | {"bedrock"}
