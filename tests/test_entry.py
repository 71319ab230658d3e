import __spark_entry__ as E
from conftest import SMALL


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["total_requests"] > 0


def test_oracle_keys_are_registered():
    # every query of the core package has a SQL twin but the randomised sketches, whose rank error test_stores.py checks
    assert set(E.ORACLES) <= set(E.QUERIES)
    assert set(E.QUERIES) - set(E.ORACLES) == {"sketch_percentiles_from_rollups"}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_every_query_plans_on_small_data(spark):
    for name in E.QUERIES:
        if name.startswith("stream_"):
            continue
        df = E.queries()[name](spark, SMALL)
        assert df.columns, name
