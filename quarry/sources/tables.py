"""Tables of a data folder, one Parquet dataset each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``; where it comes in fewer parts than there are cores, as small files do, dealt over the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def even(df: DataFrame, key: str) -> DataFrame:
    """``df``, for work that takes long on each row; dealt by a unique key where a part has more rows than half a core's share.

    Parts are cut by bytes, and those in which no row group of a file begins have no rows: they are counted, which reads
    no column. A part gets 1,000 rows or more, unless that leaves cores without one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.groupBy(F.spark_partition_id()).count()
    rows, most = parts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    return df.repartition(max(cores, min(4 * cores, rows // 1000)), key) if 2 * cores * most > rows else df


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers temporary views, all tables' unless some are named."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
