"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokenising.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written to the shared folder
and read again before the next one begins, so a lost executor costs no finished stage. All stages but the last return
the columns of ``documents``. Documents travel as whole rows, so columns more than the usual ones stay, whatever their
names; empty tables pass through all stages, and repeated rows count as they stand, which each stage says below.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cytolake.llm.common import shared_folder, ship
from cytolake.llm.line_dedup import deduped
from cytolake.llm.minhash_dedup import representatives
from cytolake.llm.mixing import mixed
from cytolake.llm.quality_rules import keep_passing
from cytolake.llm.sp_lattice import encode


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the base or the full policy. Null and empty texts have too few words and go; repeated rows are judged alike; a long text is measured whole."""
    return keep_passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; runs of two lines or more that the corpus repeats stay at their first place only.

    Null texts stay null, and a text that loses all its lines becomes empty. Rows without a doc_id stay as they are, rows
    that share one count as one document.
    """
    return deduped(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    Empty and null texts have no duplicates and stay, as do rows without a doc_id; of rows that repeat doc_id and text one
    stays.
    """
    ship(spark)
    return representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by Poisson counts, so that sources meet their target weights; shuffled.

    A null source is a source of its own, empty texts have no weight, and rows that repeat a doc_id get the same count.
    """
    ship(spark)
    return mixed(docs)


def tokenising(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document of the mixture; copies of a document get samples of their own.

    Null and empty texts have one segmentation, the empty one; a null doc_id has samples of its own too.
    """
    ship(spark)
    return encode(docs, copies=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("tokenising", tokenising),
]

#: Near-dedup and lattice sampling have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
