"""Insert, update, delete, upsert, sorted rewrites, views and staged transactions, on DataFrames and Parquet tables.

Plain Parquet has no row-level changes, so each operation gives the changed relation, and writing it is one step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable


def upserted(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO UPDATE: the source's row where it has the key, else the target's. Source keys must be distinct.

    A null key conflicts with none, as in a unique index.
    """
    values = [c for c in target.columns if c not in keys]
    new = source.select(*keys, F.struct(*[F.col(v) for v in values]).alias("_new"))
    old = target.select(*keys, F.struct(*[F.col(v) for v in values]).alias("_old"))
    both = old.join(new, keys, "full_outer")
    value = F.when(F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
    return both.select(*keys, value.alias("_v")).select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in target.columns])


def updated(target: DataFrame, where: Column, **values: Column) -> DataFrame:
    """UPDATE … SET … WHERE; rows for which the condition is null stay as they are."""
    hit = F.coalesce(where, F.lit(False))
    return target.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(target: DataFrame, where: Column) -> DataFrame:
    """DELETE … WHERE; rows for which the condition is null stay."""
    return target.filter(~F.coalesce(where, F.lit(False)))


def inserted(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows)


def numbered(df: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """A serial column in the order given. Positions come from range partitions and their sizes, not from one task.

    The ranged rows are written to the checkpoint folder first: ranges are sampled, and another run might cut them
    elsewhere, so that counts and rows must come from one run.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = durable(ranged.select("*", F.spark_partition_id().alias("_serial_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_serial_place")))
    earlier = Window.orderBy("_serial_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_serial_part").agg(F.count(F.lit(1)).alias("_serial_rows"))  # a row for each partition
    before = sizes.select("_serial_part", F.coalesce(F.sum("_serial_rows").over(earlier), F.lit(0)).alias("_serial_before"))
    placed = ranged.join(F.broadcast(before), "_serial_part")
    return placed.select(*[F.col(c) for c in df.columns], (F.col("_serial_place") + F.col("_serial_before") + start).alias(name))


def last_of_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``; makes a source fit for ``upserted``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def create_table(spark: SparkSession, name: str, schema: str, key: str | None = None, buckets: int = 8, path: str | None = None) -> None:
    """CREATE TABLE IF NOT EXISTS; where an index would stand, the table is bucketed and sorted by its key."""
    layout = f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS" if key else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{layout}" + (f" LOCATION '{path}'" if path else ""))


def write_sorted(df: DataFrame, name: str, key: str, buckets: int = 8, path: str | None = None) -> None:
    """INSERT … SELECT … ORDER BY key: rewrites a table so that joins on its key need no shuffle."""
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def insert_joined(spark: SparkSession, name: str, joined: DataFrame) -> None:
    """INSERT INTO … SELECT … JOIN …: the rows of a join, by column name, into a table that is there."""
    joined.select(*spark.table(name).columns).write.mode("append").insertInto(name)


def truncate(spark: SparkSession, name: str) -> None:
    """DELETE without WHERE; Spark truncates managed tables only, so one whose files are elsewhere is overwritten with no rows."""
    if spark.catalog.getTable(name).tableType == "MANAGED":
        spark.sql(f"TRUNCATE TABLE {name}")
    else:
        spark.createDataFrame([], spark.table(name).schema).write.mode("overwrite").insertInto(name)


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def drop_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def materialise(spark: SparkSession, view: str, path: str | None = None) -> str:
    """Table ``<view>_materialized`` with the view's rows as they are now; left alone if it is there already."""
    name = f"{view}_materialized"
    if not spark.catalog.tableExists(name):
        writer = spark.table(view).write.format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(name)
    return name


class Transaction:
    """Changes to several relations that are seen together or not at all.

    Steps work on copies of the relations' plans; ``commit`` swaps the temporary views, ``rollback`` forgets the copies.
    Transactions don't nest, and leaving the block by an error rolls back.
    """

    open_ = False

    def __init__(self, spark: SparkSession, *views: str) -> None:
        self.spark, self.state = spark, {v: spark.table(v) for v in views}

    def __enter__(self) -> Transaction:
        if Transaction.open_:
            raise RuntimeError("a transaction is open already")
        Transaction.open_ = True
        return self

    def apply(self, view: str, change: Callable[[DataFrame], DataFrame]) -> None:
        self.state[view] = change(self.state[view])

    def commit(self) -> None:
        for view, df in self.state.items():
            df.createOrReplaceTempView(view)

    def __exit__(self, kind, *_) -> None:
        Transaction.open_ = False
        if kind is None:
            self.commit()
