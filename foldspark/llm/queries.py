"""Registered queries of this subpackage: opN_<name> with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldspark.llm import bpe, html, imatch, jaccard, licenses, mix, quality, rolling, scoring, search, secret, substring, warc
from foldspark.llm.common import read
from foldspark.llm.oracles import ORACLE

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def tokenizer() -> tuple[str, str]:
    """Path and pattern of the production vocabulary, from the package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


@query("op5_source_mix")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(read(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret.digests(secret.scan(read(spark, sf_dir, "documents")))


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), *tokenizer())


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(read(spark, sf_dir, "documents")).drop("kept")


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(read(spark, sf_dir, "documents"))


@query("op9_document_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(read(spark, sf_dir, "documents"))


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(read(spark, sf_dir, "documents")))


@query("op7_ngram_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


@query("op11_ranked_search")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op12_warc")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages"))


@query("op13_rolling_median")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling(read(spark, sf_dir, "clicks"))
