"""Intermediate tables in the shared folder of the session, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


DONE_WITH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: cuts the lineage with a
    committed table, so a lost executor costs no recomputation and no row changes between uses."""
    return save_as(df, name, options)[0]


def save_as(df: DataFrame, name: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(DONE_WITH, None)
    spark.conf.set(DONE_WITH, "true")  # the table is all that is read again: its shuffle files go when it is written
    try:
        df.write.option("compression", "zstd").options(**options or {}).parquet(path)
    finally:
        spark.conf.unset(DONE_WITH) if before is None else spark.conf.set(DONE_WITH, before)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str | None) -> None:
    """Delete a table that ``save_as`` wrote and no later plan reads."""
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slots(spark: SparkSession) -> int:
    """Partitions for a shuffle by hand: the session's setting, which a cluster scales with its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows ``(node, component)`` where the
    component is its smallest node, for every node that has an edge to another one.

    Alternating large-star and small-star rounds: each keeps the components, and all edges end
    pointing at the smallest node.  Null ends, loops and repeated edges are dropped.  Per-node
    minima are partial aggregates and the joins that hand them out may be split where one node
    has very many edges.  Every round is a table in the shared folder.
    """
    spark = edges.sparkSession
    start = (edges.where("a is not null and b is not null and a <> b")
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    cur, path = save_as(start, name)
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        nxt, to = save_as(small, name)
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)), F.sum(F.xxhash64("v", "u") % F.lit(1 << 31))).first()
        forget(spark, path)
        cur, path = nxt, to
        if mark == seen:
            break
        seen = mark
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
