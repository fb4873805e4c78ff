"""The corpus pipeline: each stage works on all that the one before it kept, and its decisions take effect.

Every stage but the last returns the columns of documents. Each stage's rows are written and read again before the next
stage begins, by `run` or by whoever calls the stages; so a stage first deletes the tables that the stage before it left.

Defined cases, for all stages: an empty table gives an empty one; rows that repeat an id, or have none, are rows of their
own and are told apart by their texts; other columns go with their rows, whatever their names; texts are taken whole.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import common, language_id, mixing, packing, shingle_join, suffix_dedup
from strandweave.llm.queries import TOKENIZER


_LEFT: list[str] = []


def _stage(f):
    """Notes which tables the stage stores, and deletes those of the stage before."""

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.delete(spark, _LEFT)
        with common.recorded(_LEFT):
            return f(spark, docs, sf_dir)

    return stage


@_stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language with a score of at least 0.5; null texts and those without a letter go."""
    return language_id.filter_known(docs, language_id.fit(docs), least=0.5)


@_stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8. Null texts and those without words stay; of equal rows one does."""
    return shingle_join.one_of_each(docs, words=5, num=80, den=100)


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes that recur are cut out wherever they stand; a document of which nothing is left goes; null texts stay."""
    return suffix_dedup.strip_repeats(docs, length=400)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a document is there as often as it is taken; one without words, or null, is not taken."""
    return mixing.apply_mix(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places; a null text is the empty one."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), end_id=0, capacity=2048)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]
#: The language model, the components and the packing can't be told in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id"), "offset")
