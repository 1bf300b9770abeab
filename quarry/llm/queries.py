"""The queries of this subpackage, by the names under which __spark_entry__ registers them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import op2_bpe
from .fingerprints import op8_document_fingerprints
from .license_scan import op5_license_scans
from .mixing import op6_mixing
from .ngram_join import op3_ngram_jaccard_join, op3_ngram_jaccard_links
from .quality_classifier import op7_quality_classifier
from .quality_rules import op4_quality_rules
from .secrets import op10_secret_scans
from .sharding import op1_sharding
from .warc import op9_warc

def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 finds before the method decides, which SQL can say."""
    return op4_quality_rules(spark, sf_dir).drop("kept", "quality")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of op10's rules, by kind."""
    return op10_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, first and last slot of each shard of op1, and all sizes together."""
    shards = op1_sharding(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    return shards


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as op1 sees them."""
    return op1_sharding(spark, sf_dir).select("doc_id", "size", "law", "source")


def mixed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and source's size of each document of op6, and whether it is taken twice at most."""
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", (F.col("taken") <= 2 * F.col("size")).alias("within"))


def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts of op8: each has its end replaced by the next document's beginning."""
    return op8_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def held_out_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of op7 that are out of range, by prediction; none should be."""
    return op7_quality_classifier(spark, sf_dir).select("doc_id", F.col("score").between(0, 1).alias("in_range"), ((F.col("score") >= 0.7).cast("int") == F.col("predicted")).alias("by_threshold"))


def warc_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each type op9 derives from the pages of each address."""
    return op9_warc(spark, sf_dir).groupBy("uri", "type").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("refers_to").alias("sources"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_bpe": op2_bpe,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op3_ngram_jaccard_links": op3_ngram_jaccard_links,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scans": op5_license_scans,
    "op6_mixing": op6_mixing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_warc": op9_warc,
    "op10_secret_scans": op10_secret_scans,
    "quality_base": quality_base,
    "secret_base_counts": secret_base_counts,
    "shard_rows": shard_rows,
    "document_sizes": document_sizes,
    "mixed_sizes": mixed_sizes,
    "edited_documents": edited_documents,
    "held_out_folds": held_out_folds,
    "warc_sources": warc_sources,
}
ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * k >= 75 * (i.n + j.n - k)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT u.y, r.c FROM r JOIN u ON u.x = r.d WHERE r.c < u.y)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d
""",
    "op3_ngram_jaccard_links": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * k >= 75 * (i.n + j.n - k)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT u.y, r.c FROM r JOIN u ON u.x = r.d WHERE r.c < u.y)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, coalesce(any_value(k.k), 0) AS n_links FROM r LEFT JOIN n ON n.doc_id = d LEFT JOIN (SELECT x, count(*) AS k FROM u GROUP BY x) k ON k.x = d GROUP BY d
""",
    "quality_base": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
t AS (SELECT doc_id, i, l[i] || chr(1) || l[i + 1] || chr(1) || l[i + 2] AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM t) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY 1),
n AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM w),
s AS (
  SELECT w.doc_id, len(l) AS n_words, coalesce(list_sum(list_transform(l, lambda x: length(x)))::bigint, 0) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(x) - len(list_distinct(x)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
""",
    "secret_base_counts": r"""
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM documents
""",
    "shard_rows": """
SELECT s AS shard, high - low AS "rows", 0 AS low, high - low - 1 AS high FROM (SELECT s, (s * n + 7) // 8 AS low, ((s + 1) * n + 7) // 8 AS high FROM (SELECT count(*) AS n FROM documents), (SELECT unnest(range(8)) AS s)) WHERE high > low
""",
    "document_sizes": "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, 'rows' AS law, source FROM documents",
    "mixed_sizes": r"""
SELECT doc_id, n AS size, sum(n) OVER (PARTITION BY source)::bigint AS source_size, true AS within FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents)
""",
    "edited_documents": """
SELECT doc_id, n AS n_chars, sha256(substr(text, 1, n - n // 2) || substr(after, 1, n // 2)) AS edited_sha256
FROM (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS after FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
""",
    "held_out_folds": "SELECT doc_id, true AS in_range, true AS by_threshold FROM documents",
    "warc_sources": "SELECT url AS uri, type, count(*) AS records, count(*) AS sources FROM pages, (VALUES ('metadata'), ('conversion')) t(type) GROUP BY 1, 2",
}
