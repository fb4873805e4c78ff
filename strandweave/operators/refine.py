"""From clusters to contigs: the coarsest cluster that lies on one path is taken, and its reads are called to a consensus.

What is judged per cluster runs in Arrow groups, one cluster in memory at a time.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import align as kernels
from ..storage import stored
from . import coarsen as levels_
from . import graph

_SYMBOLS = "-ACGT"


# Within one cluster, on plain Python structures.


def remove_contained(nodes: set, edges: dict) -> set:
    """Nodes left when contained ones are dropped in order of (src, dst), each judged among those still there."""
    alive = set(nodes)
    inner = lambda n: sum(d in alive and not (e["s_contained"] or e["d_contained"]) for d, e in edges.get(n, {}).items())
    for s in sorted(edges):
        for d in sorted(edges[s]):
            e = edges[s][d]
            if s not in alive or d not in alive:
                continue
            if e["s_contained"] and e["d_contained"]:
                a, b = inner(s), inner(d)
                alive.discard(s if a < b or (a == b and s < d) else d)
            elif e["s_contained"]:
                alive.discard(s)
            elif e["d_contained"]:
                alive.discard(d)
    return alive


def reduce_transitive(forward: dict[int, set]) -> dict[int, set]:
    return {a: {b for b in out if not any(b in forward.get(c, ()) for c in out if c != b)} for a, out in forward.items()}


def _backward(forward: dict[int, set]) -> dict[int, set]:
    back: dict[int, set] = defaultdict(set)
    for a, out in forward.items():
        for b in out:
            back[b].add(a)
    return back


def paths_of(nodes: set, forward: dict[int, set]) -> list[list[int]]:
    """Maximal unbranched paths; every node is on one."""
    back, seen, out = _backward(forward), set(), []
    one = lambda a, b: len(forward.get(a, ())) == 1 and len(back.get(b, ())) == 1
    for n in sorted(nodes, key=lambda n: (any(one(a, n) for a in back.get(n, ())), n)):  # first nodes of paths come first
        if n in seen:
            continue
        path = [n]
        seen.add(n)
        while len(forward.get(path[-1], ())) == 1:
            (b,) = forward[path[-1]]
            if b in seen or not one(path[-1], b):
                break
            path.append(b)
            seen.add(b)
        out.append(path)
    return out


def trim_dead_ends(nodes: set, forward: dict[int, set], longest: int = 4, weights: dict | None = None) -> tuple[set, dict[int, set]]:
    """Drop unbranched paths that end in the open, are short (by nodes or by weight), and under half of all nodes."""
    back = _backward(forward)
    gone: set = set()
    for path in paths_of(nodes, forward):
        fed, feeds = bool(back.get(path[0])), bool(forward.get(path[-1]))
        size = sum(weights[n] for n in path) if weights else len(path)
        if fed != feeds and size <= longest and 2 * len(path) < len(nodes):
            gone.update(path)
    left = nodes - gone
    return left, {a: {b for b in out if b in left} for a, out in forward.items() if a in left}


def pop_bubbles(nodes: set, forward: dict[int, set], seqs: dict[int, str], longest: int = 4, identity: float = 90.0) -> tuple[set, dict[int, set]]:
    """Where two branches of a node meet again: a direct edge beside a branch goes; of two branches whose reads agree, the
    lighter (then later) one goes."""
    nodes, forward = set(nodes), {a: set(out) for a, out in forward.items()}
    for start in sorted(nodes):
        again = True
        while again and start in nodes and len(forward.get(start, ())) > 1:
            again = False
            reached: dict[int, list[int]] = {}
            for first in sorted(forward[start]):
                path, n = [], first
                while n is not None and len(path) <= longest:
                    if n in reached and reached[n] != path:
                        other = reached[n]
                        if not path or not other:
                            forward[start].discard(n)
                            again = True
                        elif _agree(path, other, seqs, identity):
                            drop = path if len(path) <= len(other) else other
                            nodes.difference_update(drop)
                            forward = {a: {b for b in out if b in nodes} for a, out in forward.items() if a in nodes}
                            again = True
                        break
                    reached[n] = list(path)
                    path.append(n)
                    out = forward.get(n, ())
                    n = next(iter(out)) if len(out) == 1 else None
                if again:
                    break
    return nodes, forward


def _agree(a: list[int], b: list[int], seqs: dict[int, str], identity: float) -> bool:
    steps = max(len(a), len(b))
    pairs = [(a[min(i, len(a) - 1)], b[min(i, len(b) - 1)]) for i in range(steps)]
    return all(kernels.align(seqs[x], seqs[y], free_ends=True).identity >= identity for x, y in pairs)


def consensus(path: list[int], seqs: dict[int, str], inside: dict[int, list[int]] | None = None, second: float = 0.20, deep: int = 5) -> tuple[str, str, dict[int, int]]:
    """Contig, flags and read starts of reads along a path, and of reads contained in them.

    Each read is aligned with the end of what is laid so far, and votes in the columns it covers. A column's commonest
    symbol is called, or nothing if that is a gap. A column more than `deep` deep whose runner-up has `second` of the votes
    is flagged "@", others "$".
    """
    votes: list[list[int]] = []
    starts: dict[int, int] = {}

    def call(column: list[int]) -> str:
        return _SYMBOLS[max(range(5), key=lambda i: (column[i], i))]

    def lay(read: int, tail: int) -> None:
        seq = seqs[read]
        lo = max(0, len(votes) - tail)
        have = "".join("ACGT"[int(np.argmax(c[1:]))] for c in votes[lo:])
        x = kernels.align(have, seq, free_ends=True, rows=True)
        starts[read] = lo + x.a_start - x.b_start if x.b_start == 0 else lo + x.a_start
        at = lo + x.a_start
        for p, q in zip(x.a_row, x.b_row, strict=True):
            if p == "-":
                depth = sum(votes[at - 1]) if at else 1
                votes.insert(at, [depth, 0, 0, 0, 0])
            votes[at][_SYMBOLS.find(q) if q in _SYMBOLS else 1] += 1
            at += 1
        for q in seq[x.b_end :] if at == len(votes) else "":
            column = [0] * 5
            column[_SYMBOLS.find(q) if q in _SYMBOLS else 1] = 1
            votes.append(column)

    for i, read in enumerate(path):
        if i == 0:
            for q in seqs[read]:
                column = [0] * 5
                column[_SYMBOLS.find(q) if q in _SYMBOLS else 1] = 1
                votes.append(column)
            starts[read] = 0
        else:
            lay(read, 2 * max(len(seqs[path[i - 1]]), len(seqs[read])))
        for other in (inside or {}).get(read, ()):
            lay(other, 2 * len(seqs[read]))
    out, flags, place = [], [], []
    for column in votes:
        place.append(len(out))
        symbol = call(column)
        if symbol != "-":
            total = sum(column)
            runner = sorted(column)[-2]
            out.append(symbol)
            flags.append("@" if total > deep and runner >= second * total else "$")
    return "".join(out), "".join(flags), {r: place[min(max(s, 0), len(place) - 1)] if place else 0 for r, s in starts.items()}


def linearise(nodes: set, edges: dict, seqs: dict[int, str], path_len: int = 4, bubble_len: int = 4) -> list[list[int]]:
    """The cluster's paths after containment, transitive edges, tips and bubbles are dealt with."""
    alive = remove_contained(nodes, edges)
    # A right dovetail begins earlier in its source: the source lies to the right, and follows its destination.
    forward: dict[int, set] = {n: set() for n in alive}
    for a, out in edges.items():
        for b, e in out.items():
            if a in alive and b in alive and e["r_dovetail"]:
                forward[b].add(a)
    forward = reduce_transitive(forward)
    alive, forward = trim_dead_ends(alive, forward, path_len)
    alive, forward = pop_bubbles(alive, forward, seqs, bubble_len)
    alive, forward = trim_dead_ends(alive, forward, path_len)
    return paths_of(alive, forward)


# Over all clusters.

CONTIG = "cluster long, n_paths int, seq string, flags string, reads array<struct<read_id: long, pos: int>>"


def call_clusters(members: DataFrame, edges: DataFrame, reads: DataFrame, path_len: int = 4, bubble_len: int = 4, identity: float = 90.0) -> DataFrame:
    """cluster, n_paths, and for clusters of one path: seq, flags, reads. members(cluster, read_id)."""
    m = members.join(reads.select("read_id", "seq"), "read_id")
    a = members.select(F.col("read_id").alias("src"), F.col("cluster").alias("_a"))
    b = members.select(F.col("read_id").alias("dst"), F.col("cluster").alias("_b"))
    inner = edges.join(a, "src").join(b, "dst").filter("_a = _b").select(F.col("_a").alias("cluster"), "src", "dst", "s_contained", "d_contained", "r_dovetail")

    def run(key, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=["cluster", "n_paths", "seq", "flags", "reads"])
        seqs = dict(zip(own.read_id.tolist(), own.seq.tolist(), strict=True))
        adjacent: dict = defaultdict(dict)
        for s, d, sc, dc, rd in zip(*(links[c].tolist() for c in ("src", "dst", "s_contained", "d_contained", "r_dovetail")), strict=True):
            adjacent[s][d] = {"s_contained": sc, "d_contained": dc, "r_dovetail": rd}
        paths = linearise(set(seqs), adjacent, seqs, path_len, bubble_len)
        row = {"cluster": key[0], "n_paths": len(paths), "seq": None, "flags": None, "reads": None}
        if len(paths) == 1:
            on = set(paths[0])
            inside: dict = defaultdict(list)
            for r in sorted(set(seqs) - on):
                host = next((h for h in paths[0] if adjacent.get(r, {}).get(h, {}).get("s_contained")), None)
                if host is not None:
                    inside[host].append(r)
            seq, flags, places = consensus(paths[0], seqs, inside)
            row |= {"seq": seq, "flags": flags, "reads": [{"read_id": r, "pos": p} for r, p in sorted(places.items())]}
        return pd.DataFrame([row])

    return m.groupBy("cluster").cogroup(inner.groupBy("cluster")).applyInPandas(run, CONTIG)


def uncoarsen(levels: levels_.Levels, edges: DataFrame, reads: DataFrame, path_len: int = 4, bubble_len: int = 4) -> tuple[DataFrame, DataFrame]:
    """contigs(contig, level, cluster, seq, flags, n_den) and read_pos(read_id, contig, pos).

    From the top level down, clusters of reads that are not yet in a contig are linearised; those of one path become
    contigs. Reads that none absorbs become contigs of their own.
    """
    level_map = stored(levels.level_map(), "level-map") if levels.maps else None
    left = stored(reads.select("read_id"), "left")
    contigs = None
    for level in range(len(levels.maps), 0, -1):
        members = levels_.recover_clusters(level_map, level).select("cluster", "read_id")
        whole = members.join(left, "read_id", "left_semi")
        called = stored(call_clusters(whole, edges, reads, path_len, bubble_len).filter("n_paths = 1").withColumn("level", F.lit(level)), "called")
        contigs = called if contigs is None else contigs.unionByName(called)
        taken = whole.join(called.select("cluster"), "cluster", "left_semi").select("read_id")
        left = stored(left.join(taken, "read_id", "left_anti"), "left")
    single = left.join(reads.select("read_id", "seq"), "read_id").select(
        F.col("read_id").alias("cluster"), F.lit(1).alias("n_paths"), "seq", F.expr("repeat('$', length(seq))").alias("flags"),
        F.array(F.struct("read_id", F.lit(0).alias("pos"))).alias("reads"), F.lit(0).alias("level"),
    )
    everything = single if contigs is None else contigs.select(single.columns).unionByName(single)
    everything = stored(everything, "contigs")
    ids = everything.select("level", "cluster").withColumn("_l", F.col("level"))
    counts = ids.groupBy("level").agg(F.count("*").alias("_n"))
    before = counts.select("level", (F.sum("_n").over(Window.orderBy("level")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("level").orderBy("cluster")) - 1
    ids = ids.withColumn("_i", rank).join(before, "level").select("level", "cluster", (F.col("_before") + F.col("_i")).cast("long").alias("contig"))
    out = everything.join(ids, ["level", "cluster"])
    contigs = out.select("contig", "level", "cluster", "seq", "flags", F.size("reads").cast("long").alias("n_den"))
    return contigs, out.select("contig", F.inline("reads")).select("read_id", "contig", "pos")


def hybrid_map(read_pos: DataFrame, nodes: DataFrame) -> DataFrame:
    """parent, child: each read's contig, or an id of its own after the last contig."""
    top = read_pos.agg(F.coalesce(F.max("contig") + 1, F.lit(0).cast("long")).alias("n")).first().n
    joined = nodes.select(F.col("node").alias("child")).join(read_pos.select(F.col("read_id").alias("child"), F.col("contig").alias("parent")), "child", "left")
    # Ranked within slices of a hash, and across them by their counts.
    rest = joined.filter("parent IS NULL").select("child", F.pmod(F.xxhash64("child"), F.lit(1024)).alias("_s"))
    counts = rest.groupBy("_s").agg(F.count("*").alias("_n"))
    before = counts.select("_s", (F.sum("_n").over(Window.orderBy("_s")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy("child")) - 1
    rest = rest.withColumn("_i", rank).join(before, "_s").select((F.col("_before") + F.col("_i") + top).cast("long").alias("parent"), "child")
    return joined.filter("parent IS NOT NULL").select("parent", "child").unionByName(rest)


def hybrid_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    return mapping.join(nodes.withColumnRenamed("node", "child"), "child").groupBy(F.col("parent").alias("node")).agg(F.sum("n_den").alias("n_den"))


def hybrid_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    return graph.sum_edges(graph.contract(edges, mapping))


def contig_clusters(clusters: DataFrame, read_pos: DataFrame) -> DataFrame:
    """cluster, pos, contig: a cluster's contigs in the order of its reads, each once."""
    joined = clusters.join(read_pos.select("read_id", "contig"), "read_id")
    return joined.groupBy("cluster", "contig").agg(F.min("pos").alias("pos")).select("cluster", "pos", "contig")


def sections(contigs: DataFrame, size: int = 500) -> DataFrame:
    """contig, section, seq, flags: contigs cut into pieces of `size` bases."""
    cut = contigs.filter("length(seq) > 0").select("contig", "seq", "flags", F.posexplode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(size))).alias("section", "_at"))
    return cut.select("contig", "section", F.expr(f"substring(seq, _at + 1, {size})").alias("seq"), F.expr(f"substring(flags, _at + 1, {size})").alias("flags"))


def balanced_bins(sizes: DataFrame, bins: int) -> DataFrame:
    """cluster, bin: clusters dealt by size, largest first, back and forth over the bins; a spread close to the best for
    many clusters, and one that needs no state."""
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "cluster")) - 1
    turn, place = F.floor(F.col("_i") / bins), F.col("_i") % bins
    return sizes.withColumn("_i", rank).select("cluster", "size", F.when(turn % 2 == 0, place).otherwise(bins - 1 - place).cast("int").alias("bin"))
