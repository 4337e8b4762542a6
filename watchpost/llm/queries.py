"""The registered queries of the training-data operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from . import (
    decontam, line_dedup, lm_score, mixing, near_dedup, packing, quality, secrets,
    token_alignment, token_files, toxicity, url_filter, whitening,
)
from .common import table
from .oracle_sql import ORACLES  # noqa: F401


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_shards(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), path
    )
    return token_files.read_documents(spark, path)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(
        decontam.find_passages(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
        )
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.listed_hosts(pages))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("set")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(
        table(spark, sf_dir, "documents"),
        tokenizer_path("byte_bpe_50k.json"),
        tokenizer_path("piece_bpe_32k.model"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).report()


_ALL = (
    op1_token_files, op2_decontamination, op3_packing, op4_lm_score, op5_url_filter,
    op6_near_duplicates, op7_toxicity, op8_quality, op9_line_dedup, op10_secrets,
    op11_token_alignment, op12_whitening, op13_mixing,
)
QUERIES = {q.__name__: q for q in _ALL}
