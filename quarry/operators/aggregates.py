"""Aggregates by parts: min and max, sums, integer means, factorials modulo m, harmonic sums, timeouts."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable

INT_MAX, INT_MIN = 2**31 - 1, -(2**31)


def min_max(df: DataFrame, column: str) -> DataFrame:
    """Least and greatest value; of no rows, the identities INT_MAX and INT_MIN (AGG-04)."""
    return df.agg(F.coalesce(F.min(column), F.lit(INT_MAX)).alias("min"), F.coalesce(F.max(column), F.lit(INT_MIN)).alias("max"))


def int_mean(df: DataFrame, column: str) -> DataFrame:
    """Number of values and their mean, cut to an integer; null of no rows (AGG-10)."""
    total = F.sum(F.col(column).cast("long"))
    return df.agg(F.count(column).alias("count"), F.when(F.count(column) > 0, F.try_divide(total - total % F.count(column), F.count(column)).cast("long")).alias("mean"))


def factorial_mod(spark: SparkSession, n: int, m: int, parts: int | None = None) -> int:
    """n! mod m over partitions: each multiplies a range, and a task's loss only repeats its range (AGG-11, AGG-12)."""
    if n < 0 or m < 1:
        raise ValueError("n must not be negative and m must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = 1 % m
        for batch in batches:
            for i in batch["id"].tolist():
                acc = acc * i % m
        yield pd.DataFrame({"part": [str(acc)]})

    ids = spark.range(1, n + 1, numPartitions=parts or spark.sparkContext.defaultParallelism)
    found = [int(r[0]) for r in ids.mapInPandas(run, "part string").collect()]  # a number for each partition
    return reduce(lambda a, b: a * b % m, found, 1 % m)


def product_mod(df: DataFrame, column: str, m: int) -> DataFrame:
    """Product of a column modulo m, partial products first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = 1 % m
        for batch in batches:
            for x in batch.iloc[:, 0].dropna().tolist():
                acc = acc * int(x) % m
        yield pd.DataFrame({"part": [acc]})

    parts = df.select(column).mapInPandas(run, "part long")
    wide = lambda x: x.cast("decimal(19,0)")
    step = lambda a, x: wide((a * wide(x)) % F.lit(m).cast("decimal(19,0)"))
    # one number a task comes together here
    return parts.agg(F.aggregate(F.collect_list("part"), wide(F.lit(1 % m)), step).cast("long").alias("product"))


def harmonic(spark: SparkSession, n: int) -> DataFrame:
    """1 + 1/2 + … + 1/n in double, summed by parts."""
    return spark.range(1, n + 1).agg(F.sum(1.0 / F.col("id")).alias("harmonic"))


def harmonic_in_order(n: int, backward: bool = False, single: bool = False) -> Column:
    """The same as one ordered fold, forward or backward, in double or single precision: a study of rounding."""
    kind = "float" if single else "double"
    one = F.lit(1.0).cast(kind)
    ids = F.sequence(F.lit(n), F.lit(1), F.lit(-1)) if backward else F.sequence(F.lit(1), F.lit(n))
    return F.aggregate(ids, F.lit(0.0).cast(kind), lambda a, i: (a + (one / i.cast(kind)).cast(kind)).cast(kind))


def running_sum(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Sum of a key's earlier values in an order, with no task that has all of a key's rows (WIN-04).

    Rows are cut into ranges of key and order and written once; the sums of a key's ranges are added up, at most one row
    for a range, and only the rows of a range are sorted together.
    """
    ranged = durable(df.repartitionByRange(key, order).select("*", F.spark_partition_id().alias("_range")))
    earlier = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_at")).agg(F.sum(value).alias("_sum"))
    before = totals.select("_key", "_at", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    both = rows.join(before, rows[key].eqNullSafe(before["_key"]) & (rows["_range"] == before["_at"]))
    return both.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def shared_count(spark: SparkSession, workers: int, each: int) -> DataFrame:
    """What a counter shows after each of some workers has added one ``each`` times: counts a task are summed, so none is lost (AGG-30)."""
    return spark.range(0, workers * each, numPartitions=workers).agg(F.count(F.lit(1)).alias("counter"))


def within(spark: SparkSession, seconds: float, action: Callable[[], object]) -> object:
    """Runs an action and cancels its jobs after a time (AGG-06)."""
    group = f"within-{threading.get_ident()}-{id(action)}"
    spark.sparkContext.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    timer = threading.Timer(seconds, spark.sparkContext.cancelJobGroup, [group])
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()
        spark.sparkContext._jsc.clearJobGroup()
