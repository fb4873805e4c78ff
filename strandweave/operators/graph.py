"""The overlap graph as two relations: edges (src, dst, ..., stored in both directions) and nodes.

Nothing is masked in place: a smaller graph is another DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst) of level 0: the longest, then most alike; contained flags of any of them."""
    best = F.max(F.struct("ovl_len", "iden", "r_dovetail")).alias("best")
    out = edges.groupBy("src", "dst").agg(best, F.bool_or("s_contained").alias("s_contained"), F.bool_or("d_contained").alias("d_contained"))
    inner = ~F.col("s_contained") & ~F.col("d_contained")
    return out.select("src", "dst", "best.ovl_len", "best.iden", "s_contained", "d_contained", (F.col("best.r_dovetail") & inner).alias("r_dovetail"))


def sum_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst) of a higher level: summed weight; contained if all are; the side of the heaviest."""
    inner = ~F.col("s_contained") & ~F.col("d_contained")
    side = F.max(F.when(inner, F.struct("weight", "r_dovetail")))["r_dovetail"]
    out = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.bool_and("s_contained").alias("s_contained"), F.bool_and("d_contained").alias("d_contained"), F.coalesce(side, F.lit(False)).alias("r_dovetail"))
    return out


def by_weight(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Adds rank (from 1) of each edge among its source's, heaviest first, ties to the smaller dst."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc(weight), "dst")))


def with_all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with degree, 0 for those without an edge."""
    return nodes.join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def without_nodes(edges: DataFrame, masked: DataFrame) -> DataFrame:
    """Edges with neither end in masked(node)."""
    for end in ("src", "dst"):
        edges = edges.join(masked.select(F.col("node").alias(end)).distinct(), end, "left_anti")
    return edges


def between_nodes(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges with both ends in visible(node)."""
    for end in ("src", "dst"):
        edges = edges.join(visible.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return edges


def without_edges(edges: DataFrame, masked: DataFrame) -> DataFrame:
    return edges.join(masked.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def mask_contained(edges: DataFrame) -> DataFrame:
    """node of the sources of contained edges."""
    return edges.filter("s_contained").select(F.col("src").alias("node")).distinct()


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter(F.col("src") == node)


def contract(edges: DataFrame, mapping: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Edges between what mapping(child, parent) makes of their ends; loops go. Not yet summed."""
    keep = keep or [c for c in edges.columns if c not in ("src", "dst")]
    a = mapping.select(F.col("child").alias("src"), F.col("parent").alias("_s"))
    b = mapping.select(F.col("child").alias("dst"), F.col("parent").alias("_d"))
    return edges.join(a, "src").join(b, "dst").filter("_s <> _d").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *keep)


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Forward edges a -> b but for those with some a -> c -> b; one hop, judged on the input."""
    first = edges.select(F.col("src").alias("src"), F.col("dst").alias("mid"))
    second = edges.select(F.col("src").alias("mid"), F.col("dst").alias("dst"))
    return edges.join(first.join(second, "mid").select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def best_per_side(edges: DataFrame) -> DataFrame:
    """The heaviest edge on each side of each node among those without containment."""
    inner = edges.filter("NOT s_contained AND NOT d_contained")
    w = Window.partitionBy("src", "r_dovetail").orderBy(F.desc("weight"), "dst")
    return inner.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """total, cut: weight of all edges, and of those between different parts of parts(node, part)."""
    side = lambda end, name: parts.select(F.col("node").alias(end), F.col("part").alias(name))
    both = edges.join(side("src", "_p"), "src").join(side("dst", "_q"), "dst")
    return both.agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("_p") != F.col("_q"), F.col("weight")).otherwise(0)).alias("cut"))


def bisection_cut(edges: DataFrame, parts: DataFrame, a: int = 0, b: int = 1) -> DataFrame:
    """cut: weight of edges that lead from part a into part b."""
    side = lambda end, p: parts.filter(F.col("part") == p).select(F.col("node").alias(end))
    return edges.join(side("src", a), "src", "left_semi").join(side("dst", b), "dst", "left_semi").agg(F.coalesce(F.sum("weight"), F.lit(0).cast("long")).alias("cut"))


def entropy(edges: DataFrame) -> DataFrame:
    """node, entropy: sum of p ln p over a node's edges, p being the share of their weight."""
    total = F.sum("weight").over(Window.partitionBy("src"))
    p = edges.select(F.col("src").alias("node"), (F.col("weight") / total).alias("p"))
    return p.groupBy("node").agg(F.sum(F.col("p") * F.log("p")).alias("entropy"))


def branching_nodes(edges: DataFrame, nodes: DataFrame, below: float = -2.5, heaviest: int = 2000, rounds: int = 0) -> DataFrame:
    """Nodes of low entropy (after `rounds` of taking the least among neighbours) with a heavy edge; prints as positive."""
    h = entropy(edges)
    for _ in range(rounds):
        near = edges.join(h.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("entropy").alias("_near"))
        h = h.join(near, "node", "left").select("node", F.least("entropy", "_near").alias("entropy"))
    heavy = edges.groupBy(F.col("src").alias("node")).agg(F.max("weight").alias("_w")).filter(F.col("_w") >= heaviest)
    real = nodes.filter("n_den <> 0").select("node")
    return h.filter(F.col("entropy") < below).join(heavy, "node", "left_semi").join(real, "node", "left_semi").select("node", (-F.col("entropy")).alias("entropy"))


def high_degree(edges: DataFrame, above: int = 2) -> DataFrame:
    return degrees(edges).filter(F.col("degree") > above)


def _links(edges: DataFrame) -> DataFrame:
    """Forward edges a -> b that are a's only way out and b's only way in."""
    out = edges.groupBy("src").agg(F.count("*").alias("_o")).filter("_o = 1").select("src")
    into = edges.groupBy("dst").agg(F.count("*").alias("_i")).filter("_i = 1").select("dst")
    return edges.join(out, "src", "left_semi").join(into, "dst", "left_semi").select("src", "dst")


def _walk(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, back, steps, low): the first node of each node's path and how far it is; and the nodes of cycles, with the
    smallest of their cycle as low. A first node points to itself."""
    before = links.select(F.col("dst").alias("node"), F.col("src").alias("_src"))
    state = nodes.join(before, "node", "left")
    state = stored(state.select("node", F.coalesce("_src", "node").alias("back"), F.when(F.col("_src").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.least("node", "_src").alias("low")), "walk")
    for _ in range(links.count().bit_length() + 1):
        other = state.select(F.col("node").alias("back"), F.col("back").alias("_b"), F.col("steps").alias("_s"), F.col("low").alias("_l"))
        moved = state.join(other, "back").select("node", F.col("_b").alias("back"), (F.col("steps") + F.col("_s")).alias("steps"), F.least("low", "_l").alias("low"), (F.col("_s") > 0).alias("moved"))
        moved = stored(moved, "walk")
        state = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return moved.filter("NOT moved").drop("moved"), moved.filter("moved").select("node", "low")


def maximal_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """path_id, pos, node: maximal unbranched paths of a directed graph, by pointer doubling.

    A path is named by its first node; a cycle is opened at its smallest node. After i rounds each node knows the node
    2**i steps before it, so that a path of n nodes takes log2 n rounds, each one join.
    """
    links = stored(_links(edges), "links")
    found, cyclic = _walk(nodes.select("node").distinct(), links)
    if not cyclic.isEmpty():
        inside = links.join(cyclic.select(F.col("node").alias("dst"), "low"), "dst").filter("dst <> low").select("src", "dst")
        found = found.unionByName(_walk(cyclic.select("node"), inside)[0])
    return found.select(F.col("back").alias("path_id"), F.col("steps").alias("pos"), "node")


def trim_tips(edges: DataFrame, nodes: DataFrame, longest: int = 4, share: float = 0.5) -> DataFrame:
    """Nodes to drop: maximal unbranched paths that end in the open on one side, hang on a branching node on the other, have
    at most `longest` nodes, and are less than `share` of all nodes."""
    paths = maximal_paths(edges, nodes)
    total = nodes.select("node").distinct().count()
    into = edges.join(paths.select(F.col("node").alias("dst"), F.col("path_id").alias("_p")), "dst").join(paths.select(F.col("node").alias("src"), F.col("path_id").alias("_q")), "src").filter("_p <> _q")
    fed, feeds = into.select(F.col("_p").alias("path_id")).distinct(), into.select(F.col("_q").alias("path_id")).distinct()
    sizes = paths.groupBy("path_id").agg(F.count("*").alias("n"))
    sizes = sizes.join(fed.withColumn("_fed", F.lit(True)), "path_id", "left").join(feeds.withColumn("_feeds", F.lit(True)), "path_id", "left")
    one_side = F.col("_fed").isNull() != F.col("_feeds").isNull()
    short = sizes.filter((F.col("n") <= longest) & (F.col("n") < share * total) & one_side)
    return paths.join(short.select("path_id"), "path_id", "left_semi").select("node")


def contained_nodes(edges: DataFrame) -> DataFrame:
    """Nodes to drop for containment: of a pair contained in each other, the one with fewer other edges (ties: the smaller
    id); of another contained pair, the contained one. Judged on the whole graph at once."""
    inner = edges.filter("NOT s_contained AND NOT d_contained").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_n"))
    side = lambda end, name: inner.select(F.col("node").alias(end), F.col("_n").alias(name))
    both = edges.filter("s_contained OR d_contained").join(side("src", "_a"), "src", "left").join(side("dst", "_b"), "dst", "left")
    a, b = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    mutual = F.when((a < b) | ((a == b) & (F.col("src") < F.col("dst"))), F.col("src")).otherwise(F.col("dst"))
    gone: Column = F.when(F.col("s_contained") & F.col("d_contained"), mutual).when(F.col("s_contained"), F.col("src")).otherwise(F.col("dst"))
    return both.select(gone.alias("node")).distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component: the smallest node that edges lead to, ignoring direction.

    Each node takes its neighbours' smallest label; labels are then looked up once more in themselves, which halves the
    distance that is left. Rounds end when nothing changes.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = stored(both, "both")
    label = both.select(F.col("src").alias("node")).distinct()
    label = stored((nodes.select("node").unionByName(label).distinct() if nodes is not None else label).withColumn("component", F.col("node")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("_near"))
        step = label.join(near, "node", "left").select("node", "component", F.least("component", "_near").alias("_new"))
        step = step.join(label.select(F.col("node").alias("_new"), F.col("component").alias("_far")), "_new", "left")
        step = stored(step.select("node", F.least("_new", "_far").alias("component"), (F.least("_new", "_far") < F.col("component")).alias("_changed")), "labels")
        label = step.drop("_changed")
        if step.filter("_changed").isEmpty():
            return label
