"""One registered query per operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import (html_text, line_dedup, merkle, mixing, near_dup, periodic, pieces, quality,
                           rules, sharding, sql, tiling, token_counts, token_files)
from riskweave.plans.registry import Query, shipped

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame under a name."""
    def add(fn: Query) -> Query:
        QUERIES[name] = shipped(fn)
        if oracle is not None:
            SQL[name] = oracle
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_benchmark_decontamination")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(table(spark, sf_dir, "documents"),
                                table(spark, sf_dir, "benchmark"))


@query("op2_html_main_text")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


@query("op3_context_mixing_scores")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scores(table(spark, sf_dir, "documents"))


@query("op4_sentencepiece_sampling")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segmentations(table(spark, sf_dir, "documents"),
                                public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_token_counts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_quality_classifier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"),
                                  table(spark, sf_dir, "labels"))


@query("op7_quality_rules", sql.RULES)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents")).drop("rejected_by")


@query("op8_minhash_near_dedup", sql.NEAR_DUP)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_sharding")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


@query("op10_line_dedup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op11_token_files")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query("op12_merkle_manifest", sql.MERKLE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.with_runs(table(spark, sf_dir, "documents"), periodic.planted))
