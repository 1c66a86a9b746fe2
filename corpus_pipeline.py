"""The corpus pipeline: five filtering and shaping stages over ``documents``.

Each stage takes what its predecessor kept, as reread from Parquet, and all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potamos.llm import common, decontamination, line_dedup, packing, quality_rules, simhash
from potamos.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a certified rule go."""
    return quality_rules.keep_good(docs, common.table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks go from the later document; ``n_chars`` follows; a document of which no word is left goes."""
    done = line_dedup.dedup_lines(docs)
    changed = F.col("n_lines_removed") > 0
    done = done.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark stretch, or a whole item up to some words, go."""
    return decontamination.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"), one_in=decontamination.ONE_IN)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Tokenizers and alignment have no SQL; the tests hold run() against a pipeline in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written goes once the next one is done with it.

    Null and empty texts fail the base rule and go; a null id stays with its document and is last where order counts; of
    rows equal in id and text one stays; empty tables give an empty result."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
