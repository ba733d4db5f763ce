"""Corpus preparation: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stationloom.llm import exact_dedup, mixing, pieces, quality, simhash
from stationloom.llm.common import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are far from every language go.

    NULL, empty and very short texts fail. Repeated rows share a verdict, columns beyond the known ones stay, an empty
    table stays empty. A text of any length is judged whole.
    """
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the largest id.

    NULL counts as an empty text, a NULL id as smaller than any other; of rows that share id and text one stays. Other
    columns stay, an empty table stays empty.
    """
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id.

    Texts without words, NULL too, are one group. Rows that repeat the id stay together, groups without any id keep
    all their rows. Other columns stay, an empty table stays empty.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their source ask for, not at all included.

    NULL and empty texts are never taken, a NULL source is a source. Other columns stay, an empty table stays empty.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, digests of the ids and of the decoded text of every document that the mix takes.

    NULL is an empty text and has the end id alone. A document taken twice has two equal rows, an empty table none.
    """
    return pieces.digests(pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode),
]

#: The draws of the mix and the ids cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again for the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
