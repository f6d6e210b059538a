"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of docs, whatever
their names. Defined results: an empty table goes through every stage and gives an empty one. Repeated rows are scored
one for one by the classifier, lose the same lines, and are one row after near-dedup. Rows without an id are kept by
near-dedup and have lines of their own. A null or empty text has the classifier's score of an empty one, no lines, no
copies and no benchmark words, and is packed as its end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm import decontaminate, line_dedup, minhash, packing, quality
from tallgrass.llm.common import settle, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier scores 0.3 or more, learned from the labels."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without lines that an earlier one matches; a row that so loses its last words goes, and n_chars follows the text."""
    return line_dedup.without_repeats(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of near copies: five words, a similarity of 0.8."""
    return minhash.one_of_each(docs)


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words are in passages of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text and their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality", good_documents), ("line_dedup", new_lines), ("near_dedup", one_of_near_copies), ("decontamination", free_of_benchmark), ("packing", packed)]

#: A learned classifier, signatures and a genetic search have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
