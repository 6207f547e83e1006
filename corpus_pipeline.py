"""The corpus pipeline: five stages from raw documents to a weighted mix.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of documents. run() writes what a stage returns to the shared folder and reads it back for the next, so a
lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import decontaminate, linededup, mixing, simhash, toxicity
from roadweave.llm.common import forget, settle, table
from roadweave.llm.queries import WEIGHTS, levels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 by class-conditional Kneser-Ney models learned from the labels."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that stand earlier in the corpus; n_chars follows the text."""
    found = linededup.dedup_runs(docs)
    removed = found.columns[-1]  # n_removed, under a name that documents don't have
    n_chars = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars.cast("bigint")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash candidates, Jaccard similarity of 0.8 verified), the smallest doc_id."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold under 0.8 of the five-word shingles of every benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of a mix of 0.6 of all tokens by domain, language and source, with their copies."""
    return mixing.take(docs, levels(), WEIGHTS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: Trained scores and shared-hash fingerprints have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix that all stages make of the table documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
