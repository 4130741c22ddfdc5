"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  ``run`` writes every stage's result as Parquet in the shared checkpoint
folder and rereads it, so that a lost executor never costs more than the stage
it was working on.

The stages keep the columns of ``documents``; the last returns the pieces of
the remaining documents with their ids and their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refinery.llm import decontaminate, line_dedup, packing, quality, simhash
from refinery.llm.common import Scratch
from refinery.llm.queries import tokenizer_file
from refinery.session import configure, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_documents(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those with nothing left go."""
    return line_dedup.delete_repeated_lines(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of close fingerprints: that of the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece."""
    # executors also hold what the stages before left in memory
    return packing.pack_documents(docs, tokenizer_file(), texts_per_call=256, words_kept=50_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SimHash components and the packing plan are beyond SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    configure(spark)
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        docs = scratch.table(stage(spark, before, sf_dir), name)
        scratch.drop(before)
    return docs
