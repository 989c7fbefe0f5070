"""A training corpus from `documents`: rejects poor documents, keeps one of each group of near duplicates, removes repeated
passages, sanitises personal data and packs the rest into sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents. A stage's result is written as Parquet to the shared folder and read again by the next one. When a
stage begins, the result of the one before it has been written, and the tables behind that are removed.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from loomsketch.llm import packing, privacy, quality, simhash, substring
from loomsketch.llm.common import release, scope, stored, table


def _stage(f):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline", docs)
        with scope("pipeline"):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose posterior quality is below one half go."""
    return quality.keep_good(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id stays. Candidates share a covering table's bucket
    of SimHash fingerprints, or a band of min-hashes; those of similarity 0.8 by five words, checked exactly, are linked."""
    return simhash.keep_first(docs, shingle=5, similarity=0.8)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 50 words or more that a document with a smaller doc_id holds go; the document stays."""
    return substring.cut_repeats(docs)


@_stage
def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced."""
    return privacy.sanitised(docs)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and offset."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("sanitise", sanitise), ("best_fit_packing", best_fit_packing)]

#: Expectation-maximisation, min-hashes and tokens are not expressible in SQL; tests/llm/test_pipeline.py holds every stage against
#: brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        with scope("pipeline"):
            docs = stored(made, name)
    return STAGES[-1][1](spark, docs, sf_dir)
