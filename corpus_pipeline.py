"""A training-corpus pipeline over ``documents``: five stages, each applying one operator of ``cubeflow.llm``.

Each stage takes all that the one before it kept, and its decisions take effect: rejected and
duplicate documents go, superfluous lines are cut from texts, texts are cut to what the mix takes,
and the result is packed.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cubeflow.llm import lines, mixing, packing, quality, simhash
from cubeflow.llm.common import cut, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the trusted ones among them, does not reject."""
    return quality.judged(docs, table(spark, sf_dir, "labels")).where("good").select(*docs.columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one."""
    return lines.deduplicated(docs, least_words=1).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts cut to the words that the mix of sources takes, repeats included."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens in sequences of at most 2048."""
    return packing.pack(docs).drop("ids")


STAGES = [("quality", classify), ("lines", cut_lines), ("simhash", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: Tokens and a language model are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents; each result is a table in the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
