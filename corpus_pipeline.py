"""The corpus pipeline: five stages, each one operator over all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvina.llm import ngram_join, packing, pii, quality, toxicity
from corvina.llm.common import drop_written, load, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy accepts."""
    return quality.keep(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold by a model fitted on the labelled ones among them."""
    return toxicity.keep(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: word 5-grams at a similarity of 0.8 or more."""
    return ngram_join.keep(docs, 5, 80)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data."""
    return pii.replace(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("pii", pii_surrogates),
    ("packing", pack_sequences),
]

#: Learned scores, components and library tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them, and deleted once it has.

    Null and empty texts fail the quality rules; repeated rows and ids, ties, empty tables and columns of any name
    are handled by each stage as its operator's docstring states. The last stage's input stays for its lazy result.
    """
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        new = written(stage(spark, docs, sf_dir), name)
        if k:
            drop_written(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
