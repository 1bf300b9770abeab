"""The corpus pipeline: five of the training-data operators in a row, each reading what the one before it wrote.

Quality rules drop what they reject; of each group of near copies one document stays; secrets are masked; the mix repeats
or leaves out documents by source; and what is left is encoded. Every stage works on all rows that it is given.

Null and empty texts fail the quality rules' base test and go; texts of any length are taken whole; repeated rows are
copies, of which one stays; a null doc_id or source is a value like others; extra columns pass all stages but the last,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, common, mixing, ngram_join, quality_rules, secrets

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.distinct_documents(docs)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, TOKENIZER, keep_ids=True, carry=("doc_id", "source"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("secret scans", secrets_masked), ("mixing sources", mix), ("BPE encoding", encode)]
#: No SQL: expectation-maximisation, the tokenizer and the character models are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next.

    What a stage has read is deleted once its own rows are written, so that two stages' rows are there at most.
    """
    docs, at = common.documents(spark, sf_dir), f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            common.removed(spark, f"{at}/{k - 1}")
    return docs
