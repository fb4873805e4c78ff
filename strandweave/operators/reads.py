"""From raw reads to a read set: trimming, filtering, both strands, ids.

A read set has read_id, label, seq, qual (ASCII, offset 33), len and strand. Ids are given once, by length and input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from ..storage import stored


def trim_n(reads: DataFrame) -> DataFrame:
    """Drop N at the end of each sequence, and the scores that go with it."""
    out = reads.withColumn("seq", F.regexp_replace("seq", "N+$", ""))
    return out.withColumn("qual", F.expr("substring(qual, 1, length(seq))")) if "qual" in reads.columns else out


def trim_ends(reads: DataFrame, trim5: int = 0, trim3: int = 0) -> DataFrame:
    """Drop so many bases at the start and at the end."""
    for c in [c for c in ("seq", "qual") if c in reads.columns]:
        reads = reads.withColumn(c, F.expr(f"substring({c}, {trim5 + 1}, greatest(length({c}) - {trim5 + trim3}, 0))"))
    return reads


def good_windows(scores: Column, window: int = 20, least: int = 25) -> Column:
    """For each start of a window of scores, whether its mean is at least `least`."""
    n = F.size(scores)
    whole = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))
    return F.transform(whole, lambda i: (n >= window) & (F.aggregate(F.slice(scores, i + 1, window), F.lit(0), lambda a, x: a + x) >= least * window))


def kept_range(good: Column, n: Column, window: int = 20) -> tuple[Column, Column]:
    """Start and end (exclusive, from 0) of n bases that good windows leave.

    The end moves left until the window that ends there is good or none fits; then the start moves right likewise.
    """
    place = F.array_position(F.reverse(good), True)
    end = F.when(n <= window, n).when(place > 0, n - place + 1).otherwise(window).cast("int")
    first = F.array_position(F.slice(good, 1, F.greatest(end - window + 1, F.lit(1))), True)
    start = F.when(end <= window, 0).when(first > 0, first - 1).otherwise(end - window).cast("int")
    return start, end


def quality_trim(reads: DataFrame, window: int = 20, least: int = 25) -> DataFrame:
    """Cut both ends by sliding mean quality; adds kept_start and kept_end."""
    reads = reads.withColumn("_scores", dna.phred(F.col("qual"))).withColumn("_good", good_windows(F.col("_scores"), window, least))
    start, end = kept_range(F.col("_good"), F.size("_scores"), window)
    reads = reads.withColumn("kept_start", start).withColumn("kept_end", end)
    for c in ("seq", "qual"):
        reads = reads.withColumn(c, F.expr(f"substring({c}, kept_start + 1, kept_end - kept_start)"))
    return reads.drop("_scores", "_good")


def default_quality(reads: DataFrame, score: int = 40) -> DataFrame:
    """The same good score for every base of reads that came without."""
    return reads.withColumn("qual", F.expr(f"repeat('{chr(33 + score)}', length(seq))"))


def long_enough(reads: DataFrame, least: int = 75) -> DataFrame:
    return reads.filter(F.length("seq") >= least)


def both_strands(reads: DataFrame) -> DataFrame:
    """Each read (strand 0) and its reverse complement (strand 1, label_rev), made in one pass over the reads."""
    both = F.array(
        F.struct(F.lit(0).cast("byte").alias("strand"), F.col("label").alias("label"), F.col("seq").alias("seq"), F.col("qual").alias("qual")),
        F.struct(F.lit(1).cast("byte").alias("strand"), F.concat("label", F.lit("_rev")).alias("label"), dna.reverse_complement(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual")),
    )
    rest = [c for c in reads.columns if c not in ("label", "seq", "qual")]
    return reads.select(*rest, F.inline(both))


def number_by_length(reads: DataFrame, order: list[str]) -> DataFrame:
    """read_id from 0 over (length descending, then `order` descending, a total order of the input).

    The rows are range-partitioned in that order and written, counted by partition, and ranked within their partition: no
    task holds more than its range, even where all reads have one length.
    """
    keys = [F.desc("len"), *[F.desc(c) for c in order]]
    sorted_ = reads.withColumn("len", F.length("seq")).repartitionByRange(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    sorted_ = stored(sorted_.withColumn("_p", F.spark_partition_id()), "by-length")
    counts = sorted_.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*keys)) - 1
    ranked = sorted_.withColumn("_rank", rank).join(before, "_p")
    return ranked.withColumn("read_id", (F.col("_before") + F.col("_rank")).cast("long")).drop("_p", "_before", "_rank")


def short_label(reads: DataFrame, size: int = 10) -> DataFrame:
    return reads.withColumn("label", F.substring("label", 1, size))


def preprocess(reads: DataFrame, order: list[str], window: int = 20, least_quality: int = 25, least_length: int = 75, trim5: int = 0, trim3: int = 0, label_size: int = 10) -> DataFrame:
    """The whole stage: raw reads (label, seq, perhaps qual, and the columns of `order`) to a read set."""
    reads = reads.withColumn("seq", F.upper("seq"))
    reads = trim_n(reads)
    reads = reads if "qual" in reads.columns else default_quality(reads)
    reads = quality_trim(trim_ends(reads, trim5, trim3), window, least_quality)
    reads = short_label(long_enough(reads, least_length), label_size)
    return number_by_length(both_strands(reads), [*order, "strand"]).select("read_id", "label", "seq", "qual", "len", "strand")
