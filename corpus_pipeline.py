"""Corpus preparation in five stages, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskweave.llm.common import stored, table
from riskweave.llm.exact_dedup import without_copies
from riskweave.llm.jaccard_join import one_of_each
from riskweave.llm.mixing import mixed
from riskweave.llm.packing import pack
from riskweave.llm.quality import accepted

TOKENIZER = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the labels are those of sf_dir."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get equal shares by Poisson replication; the order is global and shuffled."""
    return mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: SQL can't express the classifier or the tokenizer; tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is written and read again as the next one's input.

    Empty tables give no pieces; null texts are judged as empty; rows with a null id are judged by their own text in every
    stage; rows that repeat id and text are kept or dropped alike, so those that stay are packed each. Labels that cannot be
    learnt from reject nothing.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if k + 1 < len(STAGES) else docs
    return docs
