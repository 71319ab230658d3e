"""Registered queries and the pipeline over the given tables."""

import brute
import pytest
from conftest import SMALL


def test_one_query_per_operator():
    import __spark_entry__ as E
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


@pytest.fixture(scope="module")
def stages(spark):
    from spanlake.llm.queries import table
    from spanlake.llm.stages import STAGES
    from spanlake.llm.store import save
    out = {"input": table(spark, SMALL, "documents")}
    docs = out["input"]
    for name, stage in STAGES:
        docs = out[name] = save(stage(spark, docs, SMALL), "test-stage")
    return {k: v.toPandas() for k, v in out.items()}


def test_columns_and_order(stages):
    names = list(stages)
    for name in names[1:-1]:
        assert list(stages[name].columns) == list(stages["input"].columns)
    for before, after in zip(names[:-2], names[1:-1]):
        assert set(stages[after].doc_id) <= set(stages[before].doc_id)


def test_each_stage_against_its_own_input(stages, spark):
    low, lines, near, leaks, packed = list(stages)[1:]
    got = stages[lines].set_index("doc_id").text.to_dict()
    assert got == brute.line_dedup(list(zip(stages[low].doc_id, stages[low].text)))
    kept = {i for i, _, c in brute.simhash(list(zip(stages[lines].doc_id, stages[lines].text))) if i == c}
    assert set(stages[near].doc_id) == kept
    items = [brute.bare_words(t) for t in spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas().text]
    stay = set(stages[leaks].doc_id)
    for i, t in zip(stages[near].doc_id, stages[near].text):
        w = brute.bare_words(t)
        own = set(w)
        likely = [x for x in items if sum(y in own for y in x) >= 0.6 * len(x)]
        best = max((brute.smith_waterman(x, w) for x in likely), default=0)
        assert (i in stay) == (best < 0.65)
    from test_token_ops import FILES, check_packing, plain_ids
    rows = list(zip(stages[leaks].doc_id, stages[leaks].text))
    used, least = check_packing(rows, list(stages[packed].itertuples()), 2048, lambda t: plain_ids(FILES[0], t))
    assert used <= 1.05 * least + 2


def test_labelled_rejects(stages, spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    first = set(stages[list(stages)[1]].doc_id)
    good, bad = labels[labels.quality == 1], labels[labels.quality == 0]
    assert sum(i in first for i in good.doc_id) >= 0.97 * len(good)
    assert sum(i in first for i in bad.doc_id) <= 0.25 * len(bad)
