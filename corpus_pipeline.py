"""The corpus pipeline: five stages over `documents`, each reading what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcweave.llm.decontamination import decontaminated
from arcweave.llm.frames import short_batches, table, written
from arcweave.llm.jaccard_join import near_duplicates_removed
from arcweave.llm.packing import best_fit_packing
from arcweave.llm.substring_dedup import substring_dedup
from arcweave.llm.toxicity import remove_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below 0.3, by a model fitted on the labelled ones among them. Null and empty texts
    score 0 and stay, as do all rows of a table without labelled rows; rows with equal texts share their lot."""
    short_batches(spark)
    return remove_toxic(docs, train(docs, table(spark, sf_dir, "labels")), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 80 % of their five-word shingles connect: that of the smallest id (null
    last), of several texts with it the one of the smallest hash. Texts without words stay; of rows with one id and one text one stays."""
    short_batches(spark)
    return near_duplicates_removed(docs, 5, 80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that start in an earlier document, by its id (null last), are cut out; null texts stay null."""
    short_batches(spark)
    return substring_dedup(docs, 50)


def benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item; null and empty texts overlap with none."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 tokens; a null or empty text is its end token alone."""
    short_batches(spark)
    return best_fit_packing(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_overlaps),
    ("best_fit_packing", packing),
]

#: Learned scores, connected components and BPE are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written to the shared folder and read again.

    Every stage but the last returns the columns it was given, further ones with any name included, and takes an
    empty table; nulls, ties and repeated rows are as the stages say."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
