"""The call fact table on storage (S5, S7 sink side).

Facts are written as Parquet partitioned by ``dt = date(created_at)`` and
sorted by ``created_at`` inside each file, so a trailing-range filter prunes
whole date folders (partition filter) and, inside a folder, Parquet row groups
by their min/max statistics.  Writes are per date partition with dynamic
partition overwrite, so a re-run of a day replaces exactly that day.

For point lookups (F4) the same rows are kept a second time, in folders by a hash of the id and sorted by id inside
each, with a Parquet Bloom filter on it: a lookup opens one folder, and in it the row groups that may hold the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_date_partition(facts: DataFrame, time_col: str = "created_at") -> DataFrame:
    return facts.withColumn("dt", F.to_date(F.col(time_col)))


def write_facts(facts: DataFrame, path: str, time_col: str = "created_at",
                files_per_day: int | None = None) -> None:
    """Append-or-replace by day: ``dynamic`` partition overwrite touches only the days present."""
    df = with_date_partition(facts, time_col)
    if files_per_day:
        # spread each day over a fixed number of files by a hash of the id, then order rows by time
        df = df.repartition(F.col("dt"), (F.xxhash64("id") % files_per_day))
    df = df.sortWithinPartitions("dt", time_col)
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dt").parquet(path))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_by_id(facts: DataFrame, path: str, key: str = "id", buckets: int = 64, mode: str = "append",
                row_group_bytes: int = 32 << 20) -> None:
    """Rows of ``facts`` in ``buckets`` folders by a hash of ``key``; NULL keys share one.

    The number of folders is part of the path, so a table that grows takes its later batches in more of them; choose
    it so that a folder of a batch is about one file.
    """
    df = facts.withColumns({"buckets": F.lit(buckets), "id_bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")})
    (df.repartition(buckets, "id_bucket").sortWithinPartitions("id_bucket", key)
     .write.mode(mode).option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
     .option("parquet.block.size", str(row_group_bytes)).partitionBy("buckets", "id_bucket").parquet(path))


def find_by_id(spark: SparkSession, path: str, value: str, key: str = "id") -> DataFrame:
    """The rows of one key: a partition filter leaves its folders, a pushed equality its row groups."""
    hit = F.lit(value)
    return (spark.read.parquet(path).where(F.col("id_bucket") == F.pmod(F.xxhash64(hit), F.col("buckets")))
            .where(F.col(key) == hit).drop("buckets", "id_bucket"))
