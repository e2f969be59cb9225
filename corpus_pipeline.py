"""Training-data pipeline over `documents`: STAGES in order, each a step (spark, docs, sf_dir) -> DataFrame.

Quality rules, language identification, near-duplicates, mixing and tokens. All stages
but the last return the columns of documents; each reads what the one before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickforge.llm import bpe, language, mixing, quality, similar
from tickforge.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v2 of the rule ledger keeps."""
    return quality.keep_good(docs, "v2")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, by filters learned from this stage's documents."""
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more."""
    return similar.keep_distinct(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row per draw of a document, with the words drawn."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every row of the mix."""
    return bpe.encode_documents(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates),
          ("mix_sources", mix_sources), ("tokens", tokens)]

#: Near-duplicates, mixing and tokens can't be expressed in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
