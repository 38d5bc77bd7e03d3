"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelkit.llm import bpe as bpe_codec
from panelkit.llm import decontaminate, language, near_dedup as minhash, quality
from panelkit.llm.common import load


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and reach the log-likelihood ratio."""
    weights = quality.fit_ratio(docs, quality.trusted_ids(load(spark, sf_dir, "labels")))
    return quality.keep_good(docs, weights)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one learned language has at least half of the words."""
    return language.keep_dominant(docs, language.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, with or without an id: five-word shingles, similarity 0.8 or more."""
    return minhash.keep_single(docs, words=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark windows."""
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of each document."""
    return bpe_codec.digests(docs)
