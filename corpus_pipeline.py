"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each stage's rows to the shared folder as
Parquet, reads them again for the next, and removes what the stages before have written. All stages but the last return the
columns of documents, and those that a caller's table has besides.

Defined cases: null and empty texts fail the quality rules and go; rows that repeat a document, and rows without a doc_id, are
documents of their own up to the near-duplicate stage, which keeps one row of each group; very long texts are judged and packed
whole; an empty table passes through every stage and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardloom.llm import decontamination, jaccard_join, packing, quality_rules, secret_scans
from cardloom.llm.common import remove_saved, saved, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with the benchmark."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secret_scans.redact_secrets(docs, secret_scans.learn_formats(docs))


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", secrets),
    ("best_fit_packing", packing_),
]

#: Tokenisers, MinHash and learned automata cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mark = written()
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        remove_saved(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
