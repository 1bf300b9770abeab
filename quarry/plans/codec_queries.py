"""Codecs, code tables and archives over ``documents``. SQL can't express these; tests hold them against their inverses."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions.codecs import decode_column, encode_column, prefix, round_trip_column
from ..session import checkpoint_dir
from ..sources import archive
from ..sources.tables import even, spread, table
from .registry import query


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(texts(spark, sf_dir))


def shared(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"


def round_trip(name: str, secondary: str = "none"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = round_trip_column(even(texts(spark, sf_dir), "doc_id"), "content", name, secondary)
        n, k = F.octet_length("content").cast("long"), F.octet_length("encoded").cast("long")
        return out.select("doc_id", n.alias("original"), k.alias("encoded"), F.round(B.compression_ratio(n, k), 4).alias("saved_percent"), (F.col("decoded") == F.col("content")).alias("same"))

    return run


for _name in ("rle", "lz77", "lz78", "huffman", "shannon", "arithmetic"):
    query(f"codec_{_name}")(round_trip(_name))
query("codec_two_stage")(round_trip("huffman", "lz78"))


@query("codec_auto")
def codec_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document by the codec that its own entropy chooses."""
    chosen = B.document_measures(contents(spark, sf_dir), "doc_id", "content").select("doc_id", B.single_stage_codec(F.col("entropy")).alias("codec"))
    out = decode_column(encode_column(contents(spark, sf_dir).join(chosen, "doc_id"), "content", "column:codec"))
    return out.select("doc_id", "codec", F.octet_length("encoded").cast("long").alias("encoded"), (F.col("decoded") == F.col("content")).alias("same"))


def code_table(spark: SparkSession, sf_dir: str, codes_of) -> DataFrame:
    """symbol, cnt, code, length from the histogram of all documents, which has 256 rows at most."""
    rows = B.byte_histogram(table(spark, sf_dir, "documents")).collect()
    counts = [0] * 256
    for r in rows:
        counts[r["byte"]] = r["cnt"]
    codes = codes_of(counts) if rows else {}
    return spark.createDataFrame([(s, counts[s], c, len(c)) for s, c in sorted(codes.items())], "symbol int, cnt long, code string, length int")


@query("huffman_codes")
def huffman_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_table(spark, sf_dir, prefix.huffman_codes)


@query("shannon_codes")
def shannon_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_table(spark, sf_dir, prefix.shannon_codes)


@query("bit_depths")
def bit_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of all documents together under codes from counts cut to some bits, with the table that those take; the best marked."""
    rows = {r["byte"]: r["cnt"] for r in B.byte_histogram(table(spark, sf_dir, "documents")).collect()}  # 256 rows at most
    counts = [rows.get(b, 0) for b in range(256)]
    most, out = max(counts), []
    for bits in B.DEPTHS:
        weights = [max(1, -(-n * (2**bits - 1) // most)) if n else 0 for n in counts]
        size = prefix.size(counts, prefix.huffman_codes(weights)) if most else 0
        out.append((bits, size, size + -(-256 * bits // 8)))
    best = min(out, key=lambda x: (x[2], x[0]))[0]
    return spark.createDataFrame([(b, e, g, b == best) for b, e, g in out], "bits int, e long, g long, best boolean")


@query("bit_depth_report")
def bit_depth_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bit_depth_report(table(spark, sf_dir, "documents"), "doc_id")


@query("rle_against_markov")
def rle_against_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes by run lengths with a table of counts, against Markov's bound with its pairs (COD-24)."""
    measured = B.document_measures(contents(spark, sf_dir), "doc_id", "content").filter("markov is not null")
    coded = encode_column(contents(spark, sf_dir), "content", "rle").select("doc_id", (F.octet_length("encoded") + 256).cast("long").alias("rle"))
    bound = (B.whole_bytes(F.col("markov")) + 6 * F.col("distinct_pairs")).alias("markov_bound")
    return measured.select("doc_id", bound).join(coded, "doc_id").withColumn("rle_is_smaller", F.col("rle") < F.col("markov_bound"))


@query("archive_round_trip", "SELECT 'doc-' || doc_id AS filename, strlen(text) AS original_size, sha256(text) AS sha256 FROM documents")
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written into archives and read again."""
    archive.register(spark)
    path = shared(spark)
    files = contents(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"), "content")
    files.write.format("quarry_archive").option("codec", "auto").option("secondary", "lz78").mode("append").save(path)
    read = spark.read.format("quarry_archive").load(path)
    return read.select("filename", "original_size", F.sha2("content", 256).alias("sha256"))


@query("archive_raw_round_trip", "SELECT 'doc-' || doc_id AS filename, strlen(text) AS original_size, strlen(text) AS compressed_size, sha256(text) AS sha256 FROM documents")
def archive_raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive.register(spark)
    path = shared(spark)
    files = contents(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"), "content")
    files.write.format("quarry_archive").option("raw", "true").mode("append").save(path)
    return spark.read.format("quarry_archive").load(path).select("filename", "original_size", "compressed_size", F.sha2("content", 256).alias("sha256"))


def whole_round_trip(name: str, secondary: str = "none"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = decode_column(encode_column(contents(spark, sf_dir), "content", name, secondary))
        return out.select("doc_id", F.octet_length("decoded").cast("long").alias("decoded"), F.sha2("decoded", 256).alias("sha256"))

    return run


for _name, _first, _second in (*((n, n, "none") for n in ("rle", "lz77", "lz78", "huffman", "shannon", "arithmetic")), ("two_stage", "arithmetic", "rle")):
    query(f"decoded_{_name}", "SELECT doc_id, strlen(text) AS decoded, sha256(text) AS sha256 FROM documents")(whole_round_trip(_first, _second))


SYMBOLS = "SELECT count(DISTINCT ch) AS symbols, true AS prefix_free, true AS known, 1.0::DOUBLE AS kraft FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS ch FROM documents)"


def code_facts(codes: DataFrame) -> DataFrame:
    """Number of codes, whether none begins another, whether each length is its code's, and the sum of 2 to minus the lengths."""
    heads = F.when(F.length("code") > 1, F.transform(F.sequence(F.lit(1), F.length("code") - 1), lambda n: F.substr(F.col("code"), F.lit(1), n)))
    clash = codes.select(F.explode(heads).alias("code")).join(codes.select("code"), "code").agg(F.count(F.lit(1))).scalar()
    return codes.agg(F.count(F.lit(1)).alias("symbols"), F.min(F.col("length") == F.length("code")).alias("known"), F.round(F.sum(F.pow(F.lit(0.5), F.col("length"))), 9).alias("kraft")).withColumn("prefix_free", clash == 0)


@query("huffman_code_facts", SYMBOLS)
def huffman_code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_facts(code_table(spark, sf_dir, prefix.huffman_codes))


@query("shannon_code_facts", SYMBOLS)
def shannon_code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_facts(code_table(spark, sf_dir, prefix.shannon_codes))
