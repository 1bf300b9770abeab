"""Files as rows: whole, in part, and listed; and tables over JDBC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S


def whole_files(spark: SparkSession, path: str, recursive: bool = True, excluded: bool = False) -> DataFrame:
    """path, length and content of every file of a folder, without what archives leave out unless ``excluded``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    if found := empty_files(spark, path, recursive):
        none = spark.createDataFrame([(p,) for p in found], "path string")
        df = df.unionByName(none.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    return df if excluded else df.filter(~S.is_excluded(S.file_name(F.col("path"))))


def empty_files(spark: SparkSession, path: str, recursive: bool = True) -> list[str]:
    """Files of no bytes, which Spark's readers skip, listed beside the driver as Spark lists files; hidden ones are left out."""
    sc, out = spark.sparkContext, []
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    todo = list(fs.globStatus(at) or [])
    while todo:
        status = todo.pop()
        if status.isDirectory():
            todo += [x for x in fs.listStatus(status.getPath()) if recursive or not x.isDirectory()]
        elif status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            out.append(status.getPath().toString())
    return sorted(out)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, filename and size of every file, without reading them."""
    return whole_files(spark, path).select("path", S.file_name(F.col("path")).alias("filename"), F.col("length").alias("size"))


def read_at(content: Column, offset: int, size: int) -> Column:
    """Bytes from a position, fewer at the end (SRC-07)."""
    return F.substring(content, offset + 1, size)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table; with a key and its bounds, read in ranges of it side by side. The driver's jar is the caller's."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()
