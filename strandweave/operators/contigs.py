"""What follows assembly: contained contigs, paths over contigs, stitching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import align as kernels
from ..sources.sequences import fasta_lines
from . import graph


def contig_fasta(contigs: DataFrame) -> DataFrame:
    """value: a record for each contig of some weight, headed by its id and weight."""
    return contigs.filter("n_den <> 0").select(fasta_lines(F.concat_ws(" ", F.concat(F.lit("contig"), "contig"), "n_den"), F.col("seq")).alias("value"))


def covers(small: str, large: str, window: int = 50, per_window: float = 0.30, overall: float = 0.10) -> bool:
    """Whether a contig lies within another: its windows are aligned one after another, each with what follows the last."""
    at, wrong, total = None, 0, 0
    for i in range(0, len(small), window):
        piece = small[i : i + window]
        lo, hi = (0, len(large)) if at is None else (at, at + 2 * len(piece))
        x = kernels.align(piece, large[lo:hi], free_ends=True)
        missed = x.mismatches + (len(piece) - (x.a_end - x.a_start))
        if missed > per_window * len(piece):
            return False
        at = lo + x.b_end
        wrong, total = wrong + missed, total + len(piece)
    return total > 0 and wrong <= overall * total


def contained_contigs(contigs: DataFrame, edges: DataFrame, lightest: int = 5) -> DataFrame:
    """node of contigs of at most `lightest` reads that lie within a neighbour at least as heavy."""
    a = contigs.filter(F.col("n_den") <= lightest).select(F.col("contig").alias("src"), F.col("n_den").alias("_sn"), F.col("seq").alias("small"))
    b = contigs.select(F.col("contig").alias("dst"), F.col("n_den").alias("_dn"), F.col("seq").alias("large"))
    pairs = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").filter("_dn > _sn OR (_dn = _sn AND src > dst)")

    @F.pandas_udf("boolean")
    def inside(small: pd.Series, large: pd.Series) -> pd.Series:
        return pd.Series([covers(s, t) for s, t in zip(small, large, strict=True)], dtype=bool)

    return pairs.filter(inside("small", "large")).select(F.col("src").alias("node")).distinct()


def reduce_trim(edges: DataFrame, nodes: DataFrame, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Transitive edges go, then tips: the graph's forward edges and nodes that are left."""
    forward = graph.transitive_reduction(edges)
    tips = graph.trim_tips(forward, nodes, longest)
    return graph.without_nodes(forward, tips), nodes.join(tips, "node", "left_anti")


def surviving_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    return graph.between_nodes(edges, visible).select("src", "dst", "ovl_len")


def stitch(left: str, right: str, window: int = 100, step: int = 50, head: int = 50, most: float = 0.15) -> str | None:
    """`left` cut where the start of `right` first fits, with `right` after it; None if it fits nowhere."""
    first = right[:head]
    for i in range(0, max(1, len(left) - head + 1), step):
        x = kernels.align(first, left[i : i + window], free_ends=True)
        missed = x.mismatches + len(first) - (x.a_end - x.a_start)
        if missed <= most * len(first):
            return left[: i + x.b_start] + right
    return None


def stitch_paths(paths: DataFrame, contigs: DataFrame, keep_unmatched: bool = True) -> DataFrame:
    """path_id, part, seq: contigs along each path joined where they fit. Where two don't fit, a new part begins; without
    `keep_unmatched` what came before is dropped."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        out, have = [], None
        for seq in rows.sort_values("pos").seq:
            joined = stitch(have, seq) if have is not None else seq
            if joined is None:
                if keep_unmatched:
                    out.append(have)
                joined = seq
            have = joined
        out.append(have)
        return pd.DataFrame({"path_id": key[0], "part": range(len(out)), "seq": out})

    rows = paths.join(contigs.select(F.col("contig").alias("node"), "seq"), "node").select("path_id", "pos", "seq")
    return rows.groupBy("path_id").applyInPandas(run, "path_id long, part int, seq string")


def extra_edges(edges: DataFrame, reads: DataFrame, identity: float = 90.0, overlap: int = 50, most: int = 4) -> DataFrame:
    """src, dst, ovl_len, iden: overlaps among the forward neighbours of branching nodes that the graph lacks, where neither
    end already has `most` forward edges."""
    out = edges.filter("r_dovetail").select("src", "dst")
    branching = out.groupBy("src").agg(F.count("*").alias("n")).filter("n > 1").select("src")
    sides = out.join(branching, "src", "left_semi")
    pairs = sides.select("src", F.col("dst").alias("a")).join(sides.select("src", F.col("dst").alias("b")), "src").filter("a < b").select("a", "b").distinct()
    pairs = pairs.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    full = out.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") >= most)
    for end in ("a", "b"):
        pairs = pairs.join(full.select(F.col("src").alias(end)), end, "left_anti")
        pairs = pairs.join(reads.select(F.col("read_id").alias(end), F.col("seq").alias(f"{end}_seq")), end)

    def run(batches):
        for batch in batches:
            rows = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["a_seq"], batch["b_seq"], strict=True):
                o = kernels.align(x, y, free_ends=True)
                src, dst = (a, b) if o.b_start == 0 else (b, a)
                rows.append((src, dst, o.length, o.identity))
            yield pd.DataFrame(rows, columns=["src", "dst", "ovl_len", "iden"])

    found = pairs.mapInPandas(run, "src long, dst long, ovl_len int, iden double")
    return found.filter((F.col("iden") >= identity) & (F.col("ovl_len") >= overlap))


def ranked_paths(paths: DataFrame) -> DataFrame:
    """path_id, size: longest first by a window over paths, not over nodes."""
    sizes = paths.groupBy("path_id").agg(F.count("*").alias("size"))
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "path_id")))
