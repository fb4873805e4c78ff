"""The queries of this subpackage, at production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audio, common, language_id, mixing, neighbours, packing, shingle_join, suffix_dedup, token_cache, token_files, url_filter

TOKENIZER = "byte_bpe_50k.json"
RULES = [
    url_filter.Rule("allow", "com/"),
    url_filter.Rule("block", "example.com/en/"),
    url_filter.Rule("allow", "www.example.com/en/"),
    url_filter.Rule("block", "net/es/"),
    url_filter.Rule("block", "net/fr/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(common.table(spark, sf_dir, "pages"), RULES)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(common.table(spark, sf_dir, "documents"), length=400)


def op3_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds recordings: every vector of embeddings is played as tones, and the sound is what is judged."""
    return audio.align_recordings(audio.render(common.table(spark, sf_dir, "embeddings")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(common.table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-files")
    token_files.write_token_files(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=2)
    return token_files.read_token_files(spark, path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=0, capacity=2048)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(common.table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that each call does the whole work."""
    return token_cache.token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_suffix_dedup, op3_audio_fingerprints, op4_jaccard_join, op5_token_files,
        op6_packing, op7_neighbours, op8_mixing, op9_language_id, op10_token_counts,
    )
}
#: None of them can be told in SQL: each holds a fitted model, a tokenizer's ids, or an iterative result. See tests/llm.
ORACLE_SQL: dict[str, str] = {}
