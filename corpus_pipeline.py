"""The corpus pipeline: five training-data operators applied to ``documents`` one after another.

``STAGES`` lists (name, function) pairs; each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame.  ``run`` writes each stage's result as Parquet into the shared folder of the session and
reads it back as the next stage's input, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm.stages import STAGES, run_stages

# The classifier's fitted scores, the similarity joins and the distributed packing have no SQL form;
# tests/llm/test_pipeline.py holds every stage against a brute-force version instead.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    return run_stages(spark, sf_dir, STAGES)
