"""A corpus pipeline: each stage works on all that the stage before it kept and is written as Parquet.

1. quality rules: documents that weak supervision rejects go;
2. near-dedup: of each group of near copies, by SimHash and then by 0.8 of their five-word shingles, the first stays;
3. benchmark decontamination: documents that hold a benchmark item, within its edit distance, go;
4. secret scan: secrets are masked in the text, and n_chars follows;
5. BPE: the texts' token ids.

Every stage takes rows with null or repeated ids, null, empty and very long texts, and extra columns of any names, which stay;
an empty table stays one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lektra.llm import bpe, decontamination, nearcopies, quality, secrets
from lektra.llm.common import fresh_path, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep; null and blank texts fail the base rules and go, equal rows are judged one by one."""
    return quality.filtered(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of near copies: least id, null last; of rows that agree in id and text one. Texts without words are one group."""
    return nearcopies.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; equal texts go or stay together, null texts stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars after it; null texts stay null."""
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of all documents; a null text has no ids."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scan", mask_secrets),
    ("bpe_encoding", encode),
]

#: SQL can't express the stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
