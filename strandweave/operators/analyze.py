"""Questions about a graph level: one number for a graph, or a value for each cluster.

Functions that give a value for each cluster take `least` and `below` to select, and `cluster` for one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna


def chosen(values: DataFrame, least: float | None = None, below: float | None = None, cluster: int | None = None) -> DataFrame:
    """Rows (cluster, value) with a value of at least `least`, under `below`, or of one cluster."""
    if least is not None:
        values = values.filter(F.col("value") >= least)
    if below is not None:
        values = values.filter(F.col("value") < below)
    return values if cluster is None else values.filter(F.col("cluster") == cluster)


def graph_averages(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """avg_degree (twice the stored edges by nodes), ovl_len and iden summed over edges, by nodes and by edges."""
    n = nodes.agg(F.count("*").alias("_n"))
    e = edges.agg(F.count("*").alias("_e"), F.sum("ovl_len").alias("_l"), F.sum("iden").alias("_i"))
    by = lambda x, y: F.col(x) / F.col(y)
    return e.join(n).select((2 * by("_e", "_n")).alias("avg_degree"), by("_l", "_n").alias("len_per_node"), by("_l", "_e").alias("len_per_edge"), by("_i", "_n").alias("iden_per_node"), by("_i", "_e").alias("iden_per_edge"))


def gc_content(reads: DataFrame) -> DataFrame:
    return reads.agg((F.sum(dna.gc(F.col("seq"))) / F.sum(dna.counted(F.col("seq")))).alias("gc"))


def density(n: Column, e: Column, factor: float = 2.0) -> Column:
    """Weight of inner edges against that of a full cluster; 0 where a cluster has fewer than two reads."""
    return F.when(n > 1, factor * e / (n * (n - 1))).otherwise(0.0)


def average_density(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.avg(density(F.col("n_den"), F.col("e_den"))).alias("avg_density"))


def average_size(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.avg("n_den").alias("avg_size"))


def cluster_gc(members: DataFrame, reads: DataFrame, **select) -> DataFrame:
    """cluster, value: share of G and C among the bases of a cluster's reads."""
    joined = members.join(reads, "read_id")
    return chosen(joined.groupBy("cluster").agg((F.sum(dna.gc(F.col("seq"))) / F.sum(dna.counted(F.col("seq")))).alias("value")), **select)


def cluster_density(nodes: DataFrame, **select) -> DataFrame:
    return chosen(nodes.select(F.col("node").alias("cluster"), density(F.col("n_den"), F.col("e_den")).alias("value")), **select)


def cluster_size(nodes: DataFrame, **select) -> DataFrame:
    return chosen(nodes.select(F.col("node").alias("cluster"), F.col("n_den").alias("value")), **select)


def _inner(members: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(members.select(F.col("read_id").alias("src"), "cluster"), "src")


def child_degree(members: DataFrame, edges: DataFrame, **select) -> DataFrame:
    """cluster, value: mean degree on level 0 of a cluster's reads."""
    d = edges.groupBy("src").agg(F.count("*").alias("_d"))
    joined = members.join(d.withColumnRenamed("src", "read_id"), "read_id", "left")
    return chosen(joined.groupBy("cluster").agg(F.avg(F.coalesce("_d", F.lit(0))).alias("value")), **select)


def node_degree(edges: DataFrame, **select) -> DataFrame:
    return chosen(edges.groupBy(F.col("src").alias("cluster")).agg(F.count("*").alias("value")), **select)


def cluster_identity(members: DataFrame, edges: DataFrame, **select) -> DataFrame:
    """cluster, value: mean identity of the level-0 edges of a cluster's reads."""
    return chosen(_inner(members, edges).groupBy("cluster").agg(F.avg("iden").alias("value")), **select)


def cluster_overlap(members: DataFrame, edges: DataFrame, **select) -> DataFrame:
    return chosen(_inner(members, edges).groupBy("cluster").agg(F.avg("ovl_len").alias("value")), **select)


def children(level_map: DataFrame, level: int, node: int | None = None) -> DataFrame:
    out = level_map.filter(F.col("level") == level)
    return out if node is None else out.filter(F.col("parent") == node)


def tetramers(members: DataFrame, reads: DataFrame, last: bool = True) -> DataFrame:
    """cluster, tetramer (0 to 255), n, share: four-base words of a cluster's reads; without `last`, not each read's last."""
    words = members.join(reads, "read_id").select("cluster", F.explode(dna.kmers(F.col("seq"), 4, 1, last)).alias("x"))
    words = words.filter("x.word RLIKE '^[ACGT]{4}$'").select("cluster", dna.code(F.col("x.word")).alias("tetramer"))
    n = words.groupBy("cluster", "tetramer").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cluster")))


def rank_between(values: DataFrame, low: float, high: float) -> DataFrame:
    """Rows whose rank by value, ties by cluster, lies within the shares [low, high] of all rows."""
    ranked = values.withColumn("rank", F.row_number().over(Window.orderBy("value", "cluster")) - 1)
    total = values.agg(F.count("*").alias("_n"))
    return ranked.join(total).filter((F.col("rank") >= low * F.col("_n")) & (F.col("rank") <= high * F.col("_n"))).drop("_n")


def cluster_dump(members: DataFrame, reads: DataFrame) -> DataFrame:
    """cluster, labels, seqs: a cluster's reads in order."""
    row = F.struct("read_id", "label", "seq")
    out = members.join(reads, "read_id").groupBy("cluster").agg(F.sort_array(F.collect_list(row)).alias("x"))
    return out.select("cluster", F.col("x.label").alias("labels"), F.col("x.seq").alias("seqs"))


def bin_loads(bins: DataFrame) -> DataFrame:
    """bins, mean, variance of the load by bin (bin, size)."""
    load = bins.groupBy("bin").agg(F.sum("size").alias("load"))
    return load.agg(F.count("*").alias("bins"), F.avg("load").alias("mean"), F.var_pop("load").alias("variance"))
