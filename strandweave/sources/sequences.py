"""Sequence files in and out. Every reader is a Spark scan, so that any store and any size will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """label, seq, file, at: records start with ">" at a line's start; sequences may span lines. `at` orders a file's records."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    raw = raw.select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    text = F.regexp_replace("value", "^>|\r", "")
    head = F.substring_index(text, "\n", 1)
    seq = F.regexp_replace(F.expr("substring(t, length(h) + 1)"), "\\s", "")
    return raw.withColumn("t", text).withColumn("h", head).filter("t <> ''").select(F.trim("h").alias("label"), seq.alias("seq"), "file", "at")


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """label, qual, file, record of a quality file of two-line records; ">" may be a score, so lines are told apart by their
    number. A read without bases has an empty line of scores; blank lines at a file's end are no records."""
    lines = _numbered(_lines(spark, path)).groupBy("file", F.floor(F.col("n") / 2).alias("record"))
    pairs = lines.agg(F.max(F.when(F.col("n") % 2 == 0, F.col("value"))).alias("head"), F.max(F.when(F.col("n") % 2 == 1, F.col("value"))).alias("qual"))
    pairs = pairs.filter("trim(head) <> ''")
    return pairs.select(F.trim(F.expr("substring(head, 2)")).alias("label"), F.rtrim(F.coalesce("qual", F.lit(""))).alias("qual"), "file", "record")


def with_quality(reads: DataFrame, quality: DataFrame) -> DataFrame:
    """Reads with their scores, by label; a read whose scores are missing, of another length, or there twice is an error."""
    once = quality.groupBy("label").agg(F.max("qual").alias("qual"), F.count("*").alias("given"))
    joined = reads.join(once, "label", "left")
    fine = (F.length("seq") == F.length("qual")) & (F.col("given") == 1)
    said = F.raise_error(F.concat(F.lit("no scores of the right length, or several, for "), F.col("label")))
    return joined.withColumn("qual", F.when(fine, F.col("qual")).otherwise(said)).drop("given")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """label, seq, qual, file, record of four-line records; blank lines at a file's end are no records."""
    lines = _numbered(_lines(spark, path))
    part = lambda i, c: F.max(F.when(F.col("n") % 4 == i, c))
    out = lines.groupBy("file", F.floor(F.col("n") / 4).alias("record")).agg(part(0, F.col("value")).alias("head"), part(1, F.col("value")).alias("seq"), part(3, F.col("value")).alias("qual"))
    out = out.filter("trim(head) <> '' AND seq IS NOT NULL")
    return out.select(F.trim(F.expr("substring(head, 2)")).alias("label"), F.rtrim("seq").alias("seq"), F.rtrim(F.coalesce("qual", F.lit(""))).alias("qual"), "file", "record")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their number in their file, from 0: a partition's lines are counted first, so that no task holds a file.

    Parts of a file are in the partitions in their order, and a part's lines follow each other.
    """
    lines = lines.withColumn("_p", F.shiftright("at", 33)).withColumn("_i", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = lines.groupBy("file", "_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_p")) - F.col("_n")
    counts = counts.select("file", "_p", (before - F.col("_first")).alias("_shift"))
    return lines.join(counts, ["file", "_p"]).withColumn("n", F.col("_i") + F.col("_shift")).drop("_p", "_i", "_shift", "at")


def fasta_lines(label: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), label, F.lit("\n"), seq)


def write_fasta(df: DataFrame, path: str, label: str = "label", seq: str = "seq") -> None:
    """Two-line records, in the order of the rows within each file."""
    df.select(fasta_lines(F.col(label).cast("string"), F.col(seq)).alias("value")).write.text(path)


def write_clusters(df: DataFrame, path: str, cluster: str = "cluster", pos: str = "pos") -> None:
    """Records of one cluster together, with a line of "*" before each cluster."""
    ordered = df.repartition(cluster).sortWithinPartitions(cluster, pos)
    first = F.row_number().over(Window.partitionBy(cluster).orderBy(pos)) == 1
    line = F.concat(F.when(first, "*\n").otherwise(""), fasta_lines(F.col("label"), F.col("seq")))
    ordered.select(cluster, pos, line.alias("value")).sortWithinPartitions(cluster, pos).select("value").write.text(path)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Any of the library's relations, as Parquet; `by` makes folders of a column such as level."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_graph_text(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """Edge list, edge weights and node weights as space-separated text."""
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(f"{path}/graph")
    edges.select(F.concat_ws(" ", "src", "dst", "weight").alias("value")).write.text(f"{path}/edge_weights")
    nodes.select(F.concat_ws(" ", "node", "n_den").alias("value")).write.text(f"{path}/node_weights")


def write_analysis(df: DataFrame, path: str) -> None:
    """Analysis results as CSV with a header."""
    df.write.option("header", True).csv(path)
