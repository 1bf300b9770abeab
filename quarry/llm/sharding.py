"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; ordering all rows by fractional rank, (rank - 1/2) divided
by the source's rows, interleaves the sources in proportion, so that every cut of that order has the mixture of the whole.
Positions are cut into shards whose row counts differ by one at most (law ``rows``).

Both orders are global, yet no task sorts a source or the table: ranks come from slice totals (``common.running``).
Texts are read once and never shuffled.

Null texts have size 1 and the CRC of an empty text; a null source is a source of its own; rows with equal doc_id are
ordered by CRC and size, and rows that are equal in all of these take any order among themselves. An empty table gives an
empty result. Copies are not kept in one shard: the method knows no groups, and a group may hold more than a shard's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICES, documents, durable, running, slice_of, source_key


def interleave(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``position`` (from 0) and ``total``. ``rows`` need a column ``h``, the seeded hash, and to be durable."""
    ranked = running(rows.withColumn("_piece", slice_of(F.col("h"))), key, "_piece", ["h", *order])
    doubled = 2 * F.col("rank") - 1
    ranked = durable(
        ranked.withColumns(
            {
                "fraction": doubled / (2 * F.col("key_rows")),
                "_at": F.expr(f"int((2 * rank - 1) * {SLICES} div (2 * key_rows))"),
                "_all": F.lit(0),
            }
        ).drop("rank", "before", "key_rows", "key_weight", "_piece")
    )
    placed = running(ranked, "_all", "_at", ["fraction", key, "h", *order])
    return placed.select(*[c for c in rows.columns], (F.col("rank") - 1).alias("position"), F.col("key_rows").alias("total"))


def shard(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = durable(
        docs.select(
            "doc_id",
            "source",
            source_key(F.col("source")).alias("_source"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ).withColumn("h", F.xxhash64(F.lit(seed), "_source", "doc_id", "text_crc32"))
    )
    placed = interleave(rows, "_source", ["doc_id", "text_crc32", "size"])
    return placed.withColumn("shard", F.expr(f"int(position * {shards} div total)")).select(
        "doc_id", "source", "size", "text_crc32", "shard", (F.col("position") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source"
    )
