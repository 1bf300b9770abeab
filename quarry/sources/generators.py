"""Seeded generators of the join tables and arrays, and the server-list source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S

DESCRIPTIONS = ("first", "second", "third", "fourth", "fifth")
STATUSES = ("active", "inactive", "pending", "completed")


def pick(values: tuple[str, ...], seed: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.rand(seed) * len(values)) + 1).cast("int"))


def between(low: int, high: int, seed: int) -> Column:
    """Whole numbers, both ends included."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int")


def key(seed: int) -> Column:
    """Two letters of A to E: 25 keys."""
    letters = tuple("ABCDE")
    return F.concat(pick(letters, seed), pick(letters, seed + 1))


def table_a(spark: SparkSession, rows: int, seed: int = 0) -> DataFrame:
    """KeyField, Value1 (1 to 99), Value2 (0 to 100), Description (SRC-13)."""
    return spark.range(rows).select(key(seed).alias("KeyField"), between(1, 99, seed + 2).alias("Value1"), (F.rand(seed + 3) * 100).alias("Value2"), pick(DESCRIPTIONS, seed + 4).alias("Description"))


def table_b(spark: SparkSession, rows: int, seed: int = 0, until: str = "2025-01-01") -> DataFrame:
    """KeyField, Value3 (1 to 99), Value4 (a time within the year before ``until``), Status."""
    at = F.to_timestamp(F.date_sub(F.lit(until).cast("date"), between(0, 364, seed + 3)))
    return spark.range(rows).select(key(seed).alias("KeyField"), between(1, 99, seed + 2).alias("Value3"), at.alias("Value4"), pick(STATUSES, seed + 4).alias("Status"))


def per_key(spark: SparkSession, keys: int, low: int, high: int, seed: int, names: tuple[str, str, str], real: bool) -> DataFrame:
    rows = spark.range(1, keys + 1).select(F.col("id").cast("int").alias(names[0]), F.explode(F.sequence(F.lit(1), between(low, high, seed))).alias("_k"))
    number = F.rand(seed + 1) * 100 if real else between(1, 100, seed + 1)
    return rows.select(names[0], pick(tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), seed + 2).alias(names[1]), number.alias(names[2]))


def master(spark: SparkSession, keys: int, low: int = 5, high: int = 15, seed: int = 0) -> DataFrame:
    """MKey, MText, Num (whole), low to high rows a key (SRC-14)."""
    return per_key(spark, keys, low, high, seed, ("MKey", "MText", "Num"), False)


def slave(spark: SparkSession, keys: int, low: int = 5, high: int = 15, seed: int = 0) -> DataFrame:
    """SKey, SText, Num (real)."""
    return per_key(spark, keys, low, high, seed, ("SKey", "SText", "Num"), True)


def integers(spark: SparkSession, n: int, high: int = 65535, seed: int = 0) -> DataFrame:
    """``value`` of 0 to ``high`` (SRC-15, SRC-16)."""
    return spark.range(n).select(between(0, high, seed).alias("value"))


def servers(lines: DataFrame) -> DataFrame:
    """host and port of the lines ``host:port`` in ``value``; blank lines and bad ports are left out (SRC-17)."""
    v = F.trim("value")
    return lines.withColumns({"host": S.host(v), "port": S.port(v)}).filter((v != "") & F.col("port").isNotNull()).drop("value")


def read_servers(spark: SparkSession, path: str) -> DataFrame:
    return servers(spark.read.text(path))
