"""The corpus pipeline: quality rules, one document of each near-duplicate group, secrets masked, sources mixed, ids of a byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; stages are written as Parquet and read again.
SQL can't express checksums or BPE, so ORACLE_SQL is None and tests hold run() against a plain version, whose first stage is the
quality rules' SQL in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldspark.llm import bpe, jaccard, mix, quality, secret
from foldspark.llm.common import delete, read, scope, table_path
from foldspark.llm.queries import tokenizer

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model keeps."""
    return quality.filter_docs(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component of the Jaccard join."""
    return jaccard.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for."""
    return mix.copies(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with bpe_ids."""
    return bpe.encoded_docs(docs, *tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result goes to the shared folder and is read from there, and the one before it is deleted."""
    docs = read(spark, sf_dir, "documents")
    base, before = table_path(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        with scope():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
