"""Token counts through a digest cache.

A text's count depends on its normalised content and on the tokenizer's version alone. Both are digested; the pair is
joined to the counts stored so far, only distinct texts that miss are encoded, and their counts are appended.

Defined cases: a null text counts as the empty one (0 bytes, 0 tokens); repeated rows each get their row in the
result; an empty table gives an empty result; columns besides doc_id and text are ignored; null doc_ids are kept.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CACHE = "digest binary, n_tokens long"


def version_digest(tokenizer: str) -> str:
    """Digest of the tokenizer file and of how it is applied; another file or another way never meets old counts."""
    with open(tokenizer, "rb") as f:
        return hashlib.sha256(b"count without special tokens, null as empty\0" + f.read()).hexdigest()


def _distinct(batches):
    """Rows whose digest this task has not met."""
    seen: set[bytes] = set()
    for b in batches:
        new = []
        for i, d in enumerate(b.column("digest").to_pylist()):
            if d not in seen:
                seen.add(d)
                new.append(i)
        yield b.take(pa.array(new, pa.int32()))


def _counter(tokenizer: str):
    def count(batches):
        counts = tokens.encoder(tokenizer).counts
        for b in common.slices(_distinct(batches), 2_500_000):
            yield pa.record_batch([b.column("digest"), pa.array(counts(b.column("text").to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return count


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    `cache` is a folder that all machines share, kept between calls; None: a new one. A text is sent once by each task
    that meets it, so that a text of which there are very many copies doesn't meet itself in one task.
    """
    spark = docs.sparkSession
    path = f"{cache or common.new_path(spark, 'token-cache')}/{version_digest(tokenizer)}"
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)  # so that it can be read
    rows = common.columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = spark.read.schema(CACHE).parquet(path)
    misses = rows.select("digest", "text").join(known, "digest", "left_anti")
    distinct = misses.mapInArrow(_distinct, misses.schema).repartition(common.partitions(spark), "digest")
    distinct.mapInArrow(_counter(tokenizer), CACHE).write.mode("append").parquet(path)
    known = spark.read.schema(CACHE).parquet(path).dropDuplicates(["digest"])  # two writers may have added the same text
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sizes.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
