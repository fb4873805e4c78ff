"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue for all trees, exact reranking.

The trees are fitted on a sample of `sample` distinct vectors; a node splits its vectors at the median of a random
projection, until `leaf` of all vectors are expected in a leaf. Every vector is indexed. A query walks all trees by one
queue, ordered by the widest margin crossed on the way, until its leaves hold `probe` vectors; each leaf scores its
queries against its vectors in one product, and only its best come out. Unless it is given, `probe` is what `recall` asks
for: for 64 queries, the true neighbours are found by brute force, and how far the walk must go for each of them is
counted. (Vectors without structure need about half of all vectors for a recall of 0.95; clustered ones far less.)

Equal vectors are one entry of the index with the k + 1 smallest of their ids, which are all that any result can name;
equal queries are searched once. So neither a very common vector nor a query asked very often meets itself in one task.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length is not the commonest one (no inner product is defined with those of another); rows that repeat an id are vectors of
their own, and each is a query if its id says so; an empty table gives an empty result; columns besides vec_id and
embedding are ignored. Scores are taken in double precision from the vectors as they are, floats or doubles.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


@dataclass
class Tree:
    normals: np.ndarray  # (nodes, dims): row i is split by node i; its children are 2 i + 1 and 2 i + 2
    cuts: np.ndarray
    counts: np.ndarray  # share of the sample in each leaf

    @property
    def depth(self) -> int:
        return int(np.log2(len(self.cuts) + 1))

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            right = np.einsum("nd,nd->n", vectors, self.normals[at]) > self.cuts[at]
            at = 2 * at + 1 + right
        return at - len(self.cuts)


def grow(sample: np.ndarray, depth: int, seed: int) -> Tree:
    """A complete tree. A node's direction joins two of its own vectors, so that it follows the data's spread."""
    rng = np.random.default_rng(seed)
    nodes = (1 << depth) - 1
    normals, cuts = np.zeros((nodes, sample.shape[1])), np.zeros(nodes)
    held: list[np.ndarray] = [np.arange(len(sample))]
    for i in range(nodes):
        rows = held[i]
        pair = rng.choice(rows, 2, replace=False) if len(rows) > 1 else []
        normal = sample[pair[0]] - sample[pair[1]] if len(pair) else rng.normal(size=sample.shape[1])
        normals[i] = normal / max(np.linalg.norm(normal), 1e-12)
        along = sample[rows] @ normals[i]
        cuts[i] = np.median(along) if len(rows) else 0.0
        right = along > cuts[i]
        held += [rows[~right], rows[right]]
    return Tree(normals, cuts, np.array([len(r) for r in held[nodes:]]) / max(1, len(sample)))


def walk(trees: list[Tree], query: np.ndarray, total: int, probe: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue, until about `probe` of `total` vectors are in them."""
    return [x for x, _ in _walk(trees, query, total, probe)]


def _walk(trees: list[Tree], query: np.ndarray, total: int, probe: float):
    """walk's leaves, each with how many vectors were in those before it."""
    sides = [t.normals @ query - t.cuts for t in trees]
    queue = [(-np.inf, t, 0) for t in range(len(trees))]
    seen, found = 0, 0.0
    while queue and (found < probe or seen < len(trees)):
        margin, t, node = heapq.heappop(queue)
        nodes, side = len(trees[t].cuts), sides[t]
        while node < nodes:
            s = side[node]
            heapq.heappush(queue, (max(margin, abs(s)), t, 2 * node + 1 + int(s <= 0)))
            node = 2 * node + 1 + int(s > 0)
        yield (t, node - nodes), found
        seen += 1
        found += trees[t].counts[node - nodes] * total


def _nearest(queries: np.ndarray, k: int):
    """Brute force: each query's k nearest of a task's vectors."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                vectors = np.array(b.column("embedding").to_pylist(), np.float64)
                scores = queries @ vectors.T
                keep = min(k, len(vectors))
                top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                rows = b.take(pa.array(top.ravel()))
                yield pa.record_batch([pa.array(np.repeat(np.arange(len(queries)), keep)), pa.array(np.take_along_axis(scores, top, 1).ravel()), rows.column("embedding")], ["query", "score", "embedding"])

    return run


def probe_for(trees: list[Tree], entries: DataFrame, queries: np.ndarray, total: int, k: int, recall: float) -> int:
    """How many vectors a walk must meet for the recall, by the true neighbours of a few queries."""
    w = Window.partitionBy("query").orderBy(F.desc("score"))
    near = entries.mapInArrow(_nearest(queries, k), f"query long, score double, {entries.schema['embedding'].simpleString().replace(':', ' ')}")
    near = near.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k).select("query", "embedding").collect()
    costs: list[float] = []
    for q, query in enumerate(queries):
        true = np.array([r.embedding for r in near if r.query == q], np.float64)
        met = dict(_walk(trees, query, total, float("inf")))
        costs += np.min([[met[t, x] for x in tree.leaves(true)] for t, tree in enumerate(trees)], axis=0).tolist()
    return int(sorted(costs)[min(len(costs) - 1, int(recall * len(costs)))]) + 1


def _assign(trees: list[Tree]):
    def run(batches):
        for b in batches:
            if b.num_rows:
                vectors = np.array(b.column("embedding").to_pylist(), np.float64)
                for t, tree in enumerate(trees):
                    yield pa.record_batch([pa.array(np.full(len(vectors), t), pa.int32()), pa.array(tree.leaves(vectors), pa.int64()), b.column("class"), b.column("low"), b.column("embedding")], ["tree", "leaf", "class", "low", "embedding"])

    return run


def _probe(trees: list[Tree], total: int, probe: int, kind: str):
    number = pa.float32() if kind == "float" else pa.float64()

    def run(batches):
        for b in batches:
            for c, v in zip(b.column("class").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                found = walk(trees, np.array(v, np.float64), total, probe)
                n = len(found)
                yield pa.record_batch([pa.array([t for t, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int64()), pa.array([c] * n, pa.int64()), pa.array([v] * n, pa.list_(number))], ["tree", "leaf", "query", "vector"])

    return run


def _scorer(k: int):
    def run(key, asked, held):
        """Each query's best of one leaf, in a row: k classes besides its own, and its own."""
        if not asked.num_rows or not held.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "classes": pa.array([], pa.list_(pa.int64())), "lows": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        classes, low = held.column("class").to_numpy(), held.column("low").to_numpy()
        vectors = np.array(held.column("embedding").to_pylist(), np.float64)
        queries, ids = np.array(asked.column("vector").to_pylist(), np.float64), asked.column("query").to_numpy()
        out = []
        for i in range(0, len(ids), 256):
            scores = queries[i : i + 256] @ vectors.T
            keep = min(k + 2, len(classes))
            top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            least = np.take_along_axis(scores, top, 1).min(axis=1)
            least -= 1e-9 * np.maximum(1, np.abs(least))
            for j in np.flatnonzero((scores >= least[:, None]).sum(axis=1) > keep).tolist():  # ties at the cut: smaller classes first
                tied = np.flatnonzero(scores[j] >= least[j])
                top[j] = tied[np.lexsort((low[tied], -(queries[i + j] * vectors[tied]).sum(axis=1)))[:keep]]
            exact = (queries[i : i + 256, None, :] * vectors[top]).sum(axis=2)  # the same value in whichever leaf they meet
            out.append((classes[top], low[top], exact))
        keep = out[0][0].shape[1]
        ends = pa.array(np.arange(0, keep * len(ids) + 1, keep), pa.int32())
        c, w, s = (np.concatenate([x[i] for x in out]).ravel() for i in range(3))
        return pa.table({"query": ids, "classes": pa.ListArray.from_arrays(ends, pa.array(c)), "lows": pa.ListArray.from_arrays(ends, pa.array(w)), "scores": pa.ListArray.from_arrays(ends, pa.array(s))})

    return run


def _merger(k: int):
    def run(key, found):
        """A query's best classes over all leaves."""
        c = found.column("classes").combine_chunks().flatten().to_numpy()
        s = found.column("scores").combine_chunks().flatten().to_numpy()
        low = found.column("lows").combine_chunks().flatten().to_numpy()
        c, first = np.unique(c, return_index=True)
        best = np.lexsort((low[first], -s[first]))[: k + 1]
        return pa.table({"query": pa.array([key[0].as_py()] * len(best), pa.int64()), "class": c[best], "score": s[first][best]})

    return run


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, trees: int = 24, leaf: int = 512, probe: int | None = None, recall: float = 0.95, sample: int = 20_000, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k nearest other rows."""
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = common.columns(vectors, vec_id="long", embedding=f"array<{kind}>").filter("vec_id IS NOT NULL AND size(embedding) > 0")
    fine = "NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = float('infinity')) AND exists(embedding, x -> x <> 0)"
    rows = rows.filter(fine)
    sizes = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == sizes[0].n)
    # The k + 1 smallest ids of each vector; Spark applies the limit before it shuffles, too.
    w = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k + 1)
    entries = few.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = common.stored(entries.withColumn("class", F.monotonically_increasing_id()), "vectors")
    total = entries.count()
    chosen = entries.filter(F.pmod(F.xxhash64("low", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30)) + 1)
    fitted = np.array([r.embedding for r in chosen.select("embedding", "low").orderBy("low", "embedding").collect()], np.float64)
    depth = max(0, min(round(np.log2(max(1, total / leaf))), int(np.log2(max(1, len(fitted) / 4)))))
    forest = [grow(fitted, depth, seed + t) for t in range(trees)]
    asked = rows.filter(F.col("vec_id") % every == 0)
    names = common.stored(asked.join(entries.select("embedding", "class"), "embedding"), "queries")
    distinct = names.groupBy("class").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"))
    if probe is None:
        tried = distinct.orderBy(F.xxhash64("least", F.lit(seed)), "least", "embedding").limit(64).collect()
        probe = probe_for(forest, entries, np.array([r.embedding for r in tried], np.float64), total, k + 1, recall) if tried else 1
    held = entries.mapInArrow(_assign(forest), f"tree int, leaf long, class long, low long, embedding array<{kind}>")
    probes = distinct.mapInArrow(_probe(forest, total, probe, kind), f"tree int, leaf long, query long, vector array<{kind}>")
    best = probes.groupBy("tree", "leaf").cogroup(held.groupBy("tree", "leaf")).applyInArrow(_scorer(k), "query long, classes array<long>, lows array<long>, scores array<double>")
    # k + 1 classes for a distinct query, of whose ids each of its rows leaves out its own.
    best = best.groupBy("query").applyInArrow(_merger(k), "query long, class long, score double")
    listed = best.join(entries.select("class", "ids"), "class").select("query", "class", "score", F.explode("ids").alias("vec_id"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k + 1)
    lists = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("i", "vec_id", "score", "class"))).alias("found"))
    names = names.select(F.col("vec_id").alias("query_id"), F.col("class").alias("query"))
    # A query's own row is one of those with its id and vector.
    own = F.filter("found", lambda x: (x["vec_id"] == F.col("query_id")) & (x["class"] == F.col("query")))
    own = F.coalesce(F.array_min(F.transform(own, lambda x: x["i"])), F.lit(-1))
    own = F.slice(F.filter("found", lambda x: x["i"] != own), 1, k)
    out = names.join(lists, "query").select("query_id", F.posexplode(own).alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
