"""Corpus pipeline: quality rules, near-duplicate join, decontamination, mixing, token shards.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from incidex.llm import bm25, decisionlist, jaccard, pfair, tokenfile
from incidex.llm.common import table
from incidex.session import cut_lineage, drop_folders, scratch_folders


_left: list[str] = []  # scratch folders of the stage before


def _stage(function):
    """A stage that first deletes what the one before it has left: that one's result is written by now."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_folders(spark, _left)
        with scratch_folders() as made:
            out = function(spark, docs, sf_dir)
        _left[:] = made
        return out

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return decisionlist.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: five-word shingles, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, k=5, percent=80)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return bm25.without_leaks(docs, bm25.Index(table(spark, sf_dir, "benchmark")))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: sources in proportion to the square root of their size."""
    return pfair.in_mixed_order(docs, cut_lineage(pfair.tempered(docs)))


@_stage
def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents, in the order of the files read (the mix), and what the shards' index gives for each key."""
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
        order = [F.col("file"), F.col("place")]
    except AnalysisException:  # not read from files: by key
        placed, order = docs, None
    shards = tokenfile.write_shards(placed, public_tokenizers.path("word_bpe_49k.json"), 2, order=order)
    return tokenfile.read_shards(shards).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_shards),
]

# No SQL: the rules are learned and the ids come from a tokenizer; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with scratch_folders() as written:
            docs = cut_lineage(out)
        drop_folders(spark, before)
        before = written
    return docs
