"""What several operators of the subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir, durable

__all__ = ["checkpoint_dir", "durable"]
#: Words are runs of anything but these six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Slices of the order by hash into which each key's rows are dealt. Fixed, so that the table of slice totals has at most
#: this many rows for a key, and large, so that the rows of one key never meet in one task.
SLICES = 4096


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table; one that comes in fewer parts than there are cores, as small files do, is dealt over the cores."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a folder of any file system that Spark knows; whether it was there."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of plans that nothing names any more, which it does after a garbage collection of the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that what is made of texts at once stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns out of the way as _d0, _d1, …, and what selects them under their own names again."""
    names = [f"_d{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array; empty for an empty or null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_of(text: Column, chars: str) -> Column:
    """How many of some characters a text has."""
    return F.regexp_count(text, F.lit("[" + "".join(c if c.isalnum() else f"\\{c}" for c in chars) + "]")).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and that sorts as the source does by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def slice_of(h: Column) -> Column:
    """Slice of a 64-bit hash; slices follow the unsigned order of the hash."""
    return F.shiftrightunsigned(h, 52).cast("int")


def running(df: DataFrame, key: str, piece: str, order: list[str], weight: str | None = None) -> DataFrame:
    """Rank and running weight of each row within its key, with no task that sees a whole key.

    ``piece`` numbers consecutive stretches of each key's order, at most SLICES of them. Piece totals are added up per key
    (at most SLICES rows in a task), joined back, and only the rows of a piece are sorted together. Adds ``rank`` (from
    1), ``before`` (weight of the earlier rows), ``key_rows`` and ``key_weight``. ``df`` is read twice: make it durable.
    """
    w = F.col(weight) if weight else F.lit(1).cast("long")
    by_key = Window.partitionBy(key)
    earlier = by_key.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        df.groupBy(key, piece)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"))
        .select(
            key,
            piece,
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
            F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"),
            F.sum("_n").over(by_key).alias("key_rows"),
            F.sum("_w").over(by_key).alias("key_weight"),
        )
    )
    within = Window.partitionBy(key, piece).orderBy(*order)
    return (
        df.join(totals, [key, piece])
        .withColumn("rank", F.col("_n0") + F.row_number().over(within))
        .withColumn("before", F.col("_w0") + F.sum(w).over(within.rowsBetween(Window.unboundedPreceding, 0)) - w)
        .drop("_n0", "_w0")
    )


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, chunks: int = 256) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key, where one key may have most of the rows.

    Each key's rows are cut by the hash of ``by`` into ``chunks``; the table goes to the chunks that there are (so at most
    that many rows for a key), and rows meet it chunk by chunk. ``rows`` is read twice: make it durable.
    """
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64(by), F.lit(chunks)).cast("int"))
    dealt = rows.select(key, "_chunk").distinct().join(table, key, "left")
    return rows.join(dealt, [key, "_chunk"], "left").drop("_chunk")
