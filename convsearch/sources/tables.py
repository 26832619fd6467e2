"""Reading the input tables (one parquet dataset per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Tables whose rows carry long text or feed per-row regex / window work.
HEAVY = ("documents", "pages", "conversations", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; column pruning and filters reach the scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return balanced(df) if name in HEAVY else df


def balanced(df: DataFrame) -> DataFrame:
    """Spread an under-partitioned scan over the cluster.

    A dataset stored as fewer splits than the cluster has cores (one large
    row group, a handful of files) would run all per-row work on that many
    tasks. Only then is a round-robin repartition added; a scan that already
    has enough splits -- any large dataset -- is returned unchanged, so at
    scale this adds no shuffle. Projections and filters still reach the scan
    below the exchange."""
    par = df.sparkSession.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    return df.repartition(par) if n < par else df
