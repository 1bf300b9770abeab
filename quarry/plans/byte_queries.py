"""Byte, pair, run and code point statistics over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..operators import aggregates
from ..sources.tables import spread, table
from .registry import query

#: Each document's bytes as a list of pairs of hexadecimal digits; their number from a pair.
HEXES = "h AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents WHERE text IS NOT NULL)"
NUMBER = "((instr('0123456789ABCDEF', {0}[1]) - 1) * 16 + instr('0123456789ABCDEF', {0}[2]) - 1)"
BYTES = f"{HEXES}, b AS (SELECT doc_id, unnest(l) AS x FROM h), c AS (SELECT x, count(*) AS cnt FROM b GROUP BY x), g AS (SELECT {NUMBER.format('x')} AS byte, cnt FROM c)"
PAIRS = f"{HEXES}, q AS (SELECT l, unnest(range(1, len(l))) AS i FROM h), p AS (SELECT l[i] AS x, l[i + 1] AS y, count(*) AS cnt FROM q GROUP BY 1, 2), g AS (SELECT {NUMBER.format('x')} AS first, {NUMBER.format('y')} AS second, cnt FROM p)"
PER_DOC = f"{HEXES}, b AS (SELECT doc_id, unnest(l) AS x FROM h), c AS (SELECT doc_id, x, count(*) AS cnt FROM b GROUP BY 1, 2), t AS (SELECT *, sum(cnt) OVER (PARTITION BY doc_id) AS n FROM c), m AS (SELECT doc_id, any_value(n) AS n, -sum(cnt * log2(cnt / n)) AS info, count(*) AS k FROM t GROUP BY 1), d AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(info, 0) + 0.0 AS info, coalesce(k, 0) AS k FROM documents LEFT JOIN m USING (doc_id))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.document_measures(docs(spark, sf_dir), "doc_id")


@query("byte_histogram", f"WITH {BYTES} SELECT byte, cnt, round(cnt / sum(cnt) OVER (), 9) AS p, round(-log2(cnt / sum(cnt) OVER ()), 6) AS info FROM g")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_information(B.byte_histogram(docs(spark, sf_dir))).select("byte", "cnt", F.round("p", 9).alias("p"), F.round("info", 6).alias("info"))


@query("byte_histogram_by_count", f"WITH {BYTES} SELECT byte, cnt FROM g ORDER BY cnt DESC, byte")
def byte_histogram_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.byte_histogram(docs(spark, sf_dir)).orderBy(F.desc("cnt"), "byte")


@query("entropy", f"WITH {PER_DOC} SELECT doc_id, n AS n_bytes, round(CASE WHEN n = 0 THEN 0 ELSE info / n END, 6) + 0.0 AS entropy, round(info, 4) + 0.0 AS lower_bound_bits FROM d")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_doc(spark, sf_dir).select("doc_id", "n_bytes", F.round("entropy", 6).alias("entropy"), F.round("information", 4).alias("lower_bound_bits"))


@query(
    "byte_summary",
    f"WITH {PER_DOC} SELECT doc_id, round(info, 4) + 0.0 AS information, round(info / 8, 4) + 0.0 AS information_bytes, cast(ceil(round(info / 8, 9)) AS bigint) AS e, cast(ceil(round(info / 8, 9)) AS bigint) + 2048 AS g64, cast(ceil(round(info / 8, 9)) AS bigint) + 256 AS g8 FROM d",
)
def byte_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.summary(per_doc(spark, sf_dir)).select("doc_id", F.round("information", 4).alias("information"), F.round("information_bytes", 4).alias("information_bytes"), "e", "g64", "g8")


@query(
    "codec_choice",
    f"""
WITH {PER_DOC}, h2 AS (SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE info / n END AS h FROM d)
SELECT doc_id, CASE WHEN h < 3 THEN 'rle' WHEN h < 4 THEN 'huffman' WHEN h < 5 THEN 'lz77' WHEN h < 6 THEN 'arithmetic' WHEN h < 7 THEN 'lz78' WHEN h < 7.5 THEN 'shannon' ELSE 'none' END AS single,
  CASE WHEN h < 4 THEN 'huffman' WHEN h < 6 THEN 'arithmetic' ELSE 'shannon' END AS "primary", CASE WHEN h < 3 THEN 'rle' WHEN h < 5 THEN 'lz77' ELSE 'lz78' END AS secondary FROM h2
""",
)
def codec_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("entropy")
    return per_doc(spark, sf_dir).select("doc_id", B.single_stage_codec(h).alias("single"), B.primary_codec(h).alias("primary"), B.secondary_codec(h).alias("secondary"))


@query(
    "markov_info",
    f"""
WITH {HEXES}, q AS (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM h), p AS (SELECT doc_id, l[i] AS x, l[i + 1] AS y, count(*) AS cnt FROM q GROUP BY 1, 2, 3),
w AS (SELECT *, sum(cnt) OVER (PARTITION BY doc_id, x) AS n FROM p), m AS (SELECT doc_id, 8 - sum(cnt * log2(cnt / n)) AS bits, count(*) AS k FROM w GROUP BY 1)
SELECT doc_id, round(bits, 4) AS bits, k AS pairs, k * 6 AS table_bytes FROM documents LEFT JOIN m USING (doc_id)
""",
)
def markov_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.col("distinct_pairs").cast("long")
    return per_doc(spark, sf_dir).select("doc_id", F.round("markov", 4).alias("bits"), pairs.alias("pairs"), (pairs * 6).alias("table_bytes"))


@query("bigram_top20", f"WITH {PAIRS} SELECT first, second, cnt FROM g ORDER BY cnt DESC, first, second LIMIT 20")
def bigram_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pair_counts(docs(spark, sf_dir)).orderBy(F.desc("cnt"), "first", "second").limit(20)


@query("conditional_probabilities", f"WITH {PAIRS} SELECT first, second, cnt, round(cnt / sum(cnt) OVER (PARTITION BY first), 9) AS p, round(-log2(cnt / sum(cnt) OVER (PARTITION BY first)), 6) + 0.0 AS info FROM g")
def conditional_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.conditional(B.pair_counts(docs(spark, sf_dir))).select("first", "second", "cnt", F.round("p", 9).alias("p"), (F.round("info", 6) + 0.0).alias("info"))


@query("repetitive_symbols", f"WITH {PAIRS}, s AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY first) AS p FROM g) SELECT first AS byte, round(p, 9) AS p FROM s WHERE first = second AND p > 0.5")
def repetitive_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.repetitive(B.pair_counts(docs(spark, sf_dir))).select("byte", F.round("p", 9).alias("p"))


@query("top_symbols", f"WITH {BYTES} SELECT byte, cnt FROM g ORDER BY cnt DESC, byte LIMIT 5")
def top_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.byte_histogram(docs(spark, sf_dir)).orderBy(F.desc("cnt"), "byte").limit(5)


@query("printable_symbols_first10", f"WITH {BYTES} SELECT byte, chr(byte::int) AS symbol, cnt FROM g WHERE byte BETWEEN 32 AND 126 ORDER BY byte LIMIT 10")
def printable_symbols_first10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.byte_histogram(docs(spark, sf_dir)).filter("byte between 32 and 126").orderBy("byte").limit(10).select("byte", F.chr("byte").alias("symbol"), "cnt")


@query("least_symbol_prefix", f"WITH {BYTES}, a AS (SELECT r.byte, coalesce(g.cnt, 0) AS cnt FROM (SELECT unnest(range(1, 256)) AS byte) r LEFT JOIN g ON g.byte = r.byte) SELECT byte, cnt FROM a ORDER BY cnt, byte LIMIT 1")
def least_symbol_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.least_frequent(B.byte_histogram(docs(spark, sf_dir)))


@query("normalised_frequencies", f"WITH {BYTES} SELECT byte, cnt, greatest(1, cast(ceil(round(cnt * 255.0::DOUBLE / max(cnt) OVER (), 9)) AS bigint)) AS weight FROM g")
def normalised_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.normalised(B.byte_histogram(docs(spark, sf_dir)), 8).select("byte", "cnt", F.col("weight").cast("long").alias("weight"))


@query("codepoint_histogram", "SELECT unicode(ch) AS code_point, count(*) AS cnt FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) GROUP BY 1")
def codepoint_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.code_points(docs(spark, sf_dir))


@query(
    "unicode_summary",
    """
WITH c AS (SELECT unicode(ch) AS cp, count(*) AS cnt FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) GROUP BY 1), t AS (SELECT *, sum(cnt) OVER () AS n FROM c),
s AS (SELECT cast(sum(cnt) AS bigint) AS symbols, count(*) AS distinct_symbols, -sum(cnt * log2(cnt / n)) AS bits,
  cast(8 + sum(8 + CASE WHEN cp <= 127 THEN 1 WHEN cp <= 2047 THEN 2 WHEN cp <= 65535 THEN 3 ELSE 4 END) AS bigint) AS table_utf8 FROM t), e AS (SELECT *, cast(ceil(round(bits / 8, 9)) AS bigint) AS e, 8 + 12 * distinct_symbols AS table_utf32 FROM s)
SELECT symbols, distinct_symbols, round(bits, 3) AS bits, e, table_utf8, table_utf32, e + table_utf8 AS g8, e + table_utf32 AS g32 FROM e
""",
)
def unicode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.unicode_summary(B.code_points(docs(spark, sf_dir))).withColumn("bits", F.round("bits", 3))


@query("utf8_lengths", "SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, strlen(text) - length(text) AS extra FROM documents")
def utf8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.octet_length("text").cast("long"), F.length("text").cast("long")
    return docs(spark, sf_dir).select("doc_id", n.alias("bytes"), k.alias("chars"), (n - k).alias("extra"))


@query(
    "rle_runs",
    f"""
WITH {HEXES}, b AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM h), s AS (SELECT doc_id, i, l[i] AS x, CASE WHEN i = 1 OR l[i] <> l[i - 1] THEN 1 ELSE 0 END AS new FROM b),
r AS (SELECT doc_id, x, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s), k AS (SELECT doc_id, run, any_value(x) AS x, count(*) AS length FROM r GROUP BY 1, 2)
SELECT {NUMBER.format('x')} AS byte, length, count(*) AS cnt FROM k GROUP BY x, length
""",
)
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.run_lengths(docs(spark, sf_dir))


@query("file_offsets", "SELECT doc_id, lang, coalesce(sum(strlen(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM documents")
def file_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = docs(spark, sf_dir).select("doc_id", "lang", F.octet_length("text").cast("long").alias("n"))
    return aggregates.running_sum(sizes, "lang", "doc_id", "n", "start").drop("n")


@query("total_size", "SELECT cast(sum(strlen(text)) AS bigint) AS bytes, count(*) AS files FROM documents")
def total_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("files"))


@query("printable_mask", "SELECT doc_id, md5(regexp_replace(text, '[^\\x20-\\x7E]', '.', 'g')) AS masked FROM documents")
def printable_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(B.printable(F.col("text")).cast("binary")).alias("masked"))


@query("grep_contains", "SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, 'tion of')")
def grep_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").contains("tion of"))


@query("utf8_validity", "SELECT doc_id, NOT contains(text, chr(65533)) AS valid, strlen(text) AS bytes FROM documents")
def utf8_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("text", "UTF-8")
    return docs(spark, sf_dir).select("doc_id", B.is_valid_utf8(data).alias("valid"), F.octet_length(data).cast("long").alias("bytes"))


@query("hex_dump", "SELECT doc_id, md5(hex(encode(text))) AS dump, lower(substr(hex(encode(text)), 9, 8)) AS bytes_4_to_7 FROM documents")
def hex_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("text", "UTF-8")
    return docs(spark, sf_dir).select("doc_id", F.md5(F.hex(data).cast("binary")).alias("dump"), F.lower(F.hex(F.substring(data, 5, 4))).alias("bytes_4_to_7"))
