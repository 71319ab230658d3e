"""Reading the given Parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


_SCHEMAS: dict[tuple[str, float], object] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; column pruning and filter pushdown reach this scan.

    The schema of a path is inferred once per file version and then passed to
    the reader, so repeated reads of a table skip footer inference on the driver.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = table_path(sf_dir, name)
    try:
        key = (path, os.path.getmtime(path))
    except OSError:  # not a local path: let Spark resolve it every time
        return spark.read.parquet(path)
    schema = _SCHEMAS.get(key)
    if schema is None:
        schema = spark.read.parquet(path).schema
        _SCHEMAS[key] = schema
    return spark.read.schema(schema).parquet(path)
