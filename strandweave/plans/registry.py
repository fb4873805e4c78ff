"""Queries over the driver's tables, each with SQL for the same rows where SQL can tell them.

Names begin with the operators of the survey that a query exercises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import analyze, coarsen, contigs, graph, kmers, overlap, partition, reads, refine
from . import inputs
from .inputs import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# Reads.


@query("SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'N+$', '') AS seq FROM documents")
def p1_trim_n(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))
    return reads.trim_n(docs)


@query(sql("SELECT read_id, substr(seq, 6, greatest(length(seq) - 12, 0)) AS seq FROM reads", "reads"))
def p2_trim_ends(spark, d):
    return reads.trim_ends(inputs.reads(spark, d).select("read_id", "seq"), 5, 7)


def _scored(spark, d):
    """A pseudo-quality for each base, from the base and its place."""
    score = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.chr(33 + (F.ascii(F.substring("seq", i, F.lit(1))) * 7 + i) % 41))
    return inputs.reads(spark, d).withColumn("qual", F.array_join(score, ""))


@query(
    sql(
        """, q AS (SELECT read_id, length(seq) AS n, unnest(range(1, length(seq) + 1)) AS i, seq FROM reads),
        w AS (SELECT read_id, n, i, sum((ascii(substr(seq, CAST(i AS INT), 1)) * 7 + i) % 41) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s FROM q),
        g AS (SELECT read_id, max(CASE WHEN i >= 20 AND s >= 400 THEN i END) AS last, min(CASE WHEN i >= 20 AND s >= 400 THEN i - 20 END) AS first FROM w GROUP BY 1),
        e AS (SELECT read_id, seq, CASE WHEN length(seq) <= 20 THEN length(seq) ELSE coalesce(last, 20) END AS e, first FROM reads JOIN g USING (read_id)),
        k AS (SELECT read_id, seq, CASE WHEN e <= 20 THEN 0 ELSE first END AS s, e FROM e)
        SELECT read_id, CAST(s AS INT) AS kept_start, CAST(e AS INT) AS kept_end, substr(seq, CAST(s + 1 AS INT), CAST(e - s AS INT)) AS seq FROM k""",
        "reads",
    ).replace(" , q AS", ", q AS")
)
def p3_p4_quality_trim(spark, d):
    return reads.quality_trim(_scored(spark, d), window=20, least=20).select("read_id", "kept_start", "kept_end", "seq")


@query(sql("SELECT read_id, seq FROM reads WHERE length(seq) >= 75", "reads"))
def p5_long_enough(spark, d):
    return reads.long_enough(inputs.reads(spark, d), 75).select("read_id", "seq")


_BOTH = """SELECT read_id, CAST(0 AS TINYINT) AS strand, 'r' || read_id AS label, seq, repeat('I', length(seq)) AS qual FROM reads
    UNION ALL SELECT read_id, CAST(1 AS TINYINT), 'r' || read_id || '_rev', reverse(translate(seq, 'ACGTN', 'TGCAN')), repeat('I', length(seq)) FROM reads"""


def _both(spark, d):
    rows = inputs.reads(spark, d).select("read_id", "seq", F.concat(F.lit("r"), "read_id").alias("label"))
    return reads.both_strands(reads.default_quality(rows)).select("read_id", "strand", "label", "seq", "qual")


@query(sql(_BOTH, "reads"))
def p6_p8_both_strands(spark, d):
    return _both(spark, d)


@query(sql(f", b AS ({_BOTH}) SELECT row_number() OVER (ORDER BY length(seq) DESC, read_id DESC, strand DESC) - 1 AS read_id, substr(label, 1, 10) AS label, length(seq) AS len FROM b", "reads").replace(" , b AS", ", b AS"))
def p7_p9_numbered(spark, d):
    rows = _both(spark, d).withColumnRenamed("read_id", "raw_id")
    return reads.short_label(reads.number_by_length(rows, ["raw_id", "strand"]), 10).select("read_id", "label", F.col("len").cast("long").alias("len"))


@query(sql("SELECT read_id, sum(CASE substr(seq, i, 1) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END * (1 << (2 * (12 - i)))) :: BIGINT AS code FROM reads, range(1, 13) t(i) WHERE length(seq) >= 12 GROUP BY 1", "reads").replace("substr(seq, i, 1)", "substr(seq, CAST(i AS INT), 1)"))
def p11_word_code(spark, d):
    return inputs.reads(spark, d).filter("length(seq) >= 12").select("read_id", dna.code(F.substring("seq", 1, 12)).alias("code"))


# The seeded join.

_SEEDS = """
    k AS (SELECT read_id, i AS pos, substr(seq, CAST(i + 1 AS INT), 22) AS word FROM (SELECT read_id, seq, unnest(range(0, length(seq) - 22, 11)) AS i FROM reads)),
    t AS (SELECT read_id, pos, max(n) AS most FROM (SELECT read_id, pos, substr(word, CAST(j AS INT), 3) AS tri, count(*) AS n FROM k, range(1, 21) x(j) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    seeds AS (SELECT k.* FROM k JOIN t USING (read_id, pos) WHERE most < 5),
    words AS (SELECT read_id, i AS pos, substr(seq, CAST(i + 1 AS INT), 22) AS word FROM (SELECT read_id, seq, unnest(range(0, length(seq) - 21)) AS i FROM reads))"""
_HITS = """
    hits AS (SELECT word, count(*) AS hits FROM words GROUP BY 1),
    f AS (SELECT read_id, pos, word, hits FROM seeds JOIN hits USING (word)),
    b AS (SELECT read_id, list_sort(list(hits)) AS h FROM f GROUP BY 1),
    c AS (SELECT read_id, len(h) AS n, h[CAST(floor(3 * len(h) / 4.0) AS INT) + 1] AS hi, h[CAST(floor(len(h) / 4.0) AS INT) + 1] AS lo FROM b),
    kept AS (SELECT read_id, pos, word, hits FROM f JOIN c USING (read_id) WHERE hits <= CASE WHEN n >= 4 AND hi + hi - lo > 0 THEN hi + hi - lo ELSE 200 END)"""
_MATCHES = "m AS (SELECT a.read_id AS q, b.read_id AS r, a.pos AS q_pos, b.pos AS r_pos FROM kept a JOIN words b USING (word) WHERE a.read_id < b.read_id)"


def _kept(spark, d):
    own = inputs.reads(spark, d).select("read_id", "seq")
    seeds, words = kmers.own_words(own)
    return kmers.without_repeats(seeds), words


@query(sql(f", {_SEEDS} SELECT read_id, pos, word FROM seeds", "reads").replace(" , ", ", ", 1))
def j1_j2_seeds(spark, d):
    # By word, not by its number, so that SQL can say the same.
    own = inputs.reads(spark, d).select("read_id", "seq")
    out = own.select("read_id", F.inline(dna.kmers(F.col("seq"), 22, 11, False)))
    return out.filter(~dna.low_complexity(F.col("word"), 22)).select("read_id", F.col("pos").cast("long").alias("pos"), "word")


@query(
    sql(
        """, s AS (SELECT read_id, i AS pos, seq FROM (SELECT read_id, seq, unnest(range(0, length(seq) - 22, 11)) AS i FROM reads)),
        m AS (SELECT read_id, pos, sum((ascii(substr(seq, CAST(pos + j AS INT), 1)) * 7 + pos + j) % 41) AS total FROM s, range(1, 23) x(j) GROUP BY 1, 2)
        SELECT read_id, pos FROM m WHERE total >= 22 * 20""",
        "reads",
    ).replace(" , ", ", ", 1)
)
def j3_quality_seeds(spark, d):
    return kmers.seeds(_scored(spark, d), complexity=None, least_quality=20).select("read_id", F.col("pos").cast("long").alias("pos"))


@query(sql(f", {_SEEDS}, {_HITS} SELECT read_id, pos, hits FROM kept", "reads").replace(" , ", ", ", 1))
def j5_repeat_filter(spark, d):
    return _kept(spark, d)[0].select("read_id", F.col("pos").cast("long").alias("pos"), "hits")


@query(sql(f", {_SEEDS}, {_HITS}, {_MATCHES} SELECT q, r, q_pos - r_pos AS diag, count(*) AS hits FROM m GROUP BY 1, 2, 3", "reads").replace(" , ", ", ", 1))
def seed_candidates(spark, d):
    """Which reads share a colinear overlap: equal words by diagonal (J1, J2, J4 to J6, J8, J18)."""
    return kmers.own_counts(inputs.reads(spark, d).select("read_id", "seq"))


@query(
    sql(
        f""", {_SEEDS}, {_HITS}, {_MATCHES},
        g AS (SELECT *, CASE WHEN q_pos - lag(q_pos) OVER w = 11 THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY q, r, q_pos - r_pos ORDER BY q_pos)),
        h AS (SELECT *, sum(fresh) OVER (PARTITION BY q, r, q_pos - r_pos ORDER BY q_pos ROWS UNBOUNDED PRECEDING) AS run FROM g)
        SELECT q, r, min(q_pos) AS q_pos, min(r_pos) AS r_pos, max(q_pos) - min(q_pos) + 22 AS size FROM h GROUP BY q, r, q_pos - r_pos, run""",
        "reads",
    ).replace(" , ", ", ", 1)
)
def j7_merged_seeds(spark, d):
    return kmers.own_runs(inputs.reads(spark, d).select("read_id", "seq"))


def _contain(spark, d):
    """A made-up containment map: every third node is represented by the one before it."""
    return inputs.nodes(spark, d).selectExpr("node AS read_id", "CASE WHEN node % 3 = 0 AND node > 1 THEN node - 1 ELSE node END AS rep_id", "CAST(80 + node % 21 AS INT) AS len_ratio")


@query(
    sql(
        """, contain AS (SELECT node AS read_id, CASE WHEN node % 3 = 0 AND node > 1 THEN node - 1 ELSE node END AS rep_id, 80 + node % 21 AS len_ratio FROM nodes)
        SELECT e.src AS q, e.dst AS r FROM edges e JOIN contain a ON a.read_id = e.src JOIN contain b ON b.read_id = e.dst
        WHERE a.rep_id <> b.rep_id AND (a.rep_id = e.src OR a.len_ratio >= 90) AND (b.rep_id = e.dst OR b.len_ratio >= 90)""",
        "edges", "nodes",
    ).replace(" , ", ", ", 1)
)
def j9_admissible(spark, d):
    return kmers.admissible(inputs.edges(spark, d).select(F.col("src").alias("q"), F.col("dst").alias("r")), _contain(spark, d))


@query(
    sql(
        """, al AS (SELECT src AS q, dst AS r, 150 AS q_len, CAST(100 + dst % 60 AS INT) AS r_len, ovl_len AS len, CAST(weight % 12 AS INT) AS mis, CAST(src % 40 AS INT) AS q_start, CAST(dst % 40 AS INT) AS r_start FROM edges WHERE src < dst),
        ok AS (SELECT *, (len - mis) / CAST(len AS DOUBLE) * 100.0 AS iden FROM al WHERE (len - mis) / CAST(len AS DOUBLE) * 100.0 >= 90 AND len >= 50),
        ty AS (SELECT *, floor(len / CAST(q_len AS DOUBLE) + 0.03 + 1e-9) >= 1 AS sc, floor(len / CAST(r_len AS DOUBLE) + 0.03 + 1e-9) >= 1 AS dc FROM ok),
        both_ends AS (SELECT q AS src, r AS dst, len, iden, sc, dc, q_start < r_start AND NOT sc AND NOT dc AS rd FROM ty UNION ALL SELECT r, q, len, iden, dc, sc, r_start < q_start AND NOT sc AND NOT dc FROM ty)
        SELECT src, dst, len AS ovl_len, round(iden, 6) AS iden, sc AS s_contained, dc AS d_contained, rd AS r_dovetail, CAST(len // 10 * 10 AS INT) AS ovl_step, floor((iden - 70) / 0.5) * 0.5 + 70 AS iden_step FROM both_ends""",
        "edges",
    ).replace(" , ", ", ", 1)
)
def j14_j16_typed_edges(spark, d):
    aligned = inputs.edges(spark, d).filter("src < dst").selectExpr(
        "src AS q", "dst AS r", "150 AS q_len", "CAST(100 + dst % 60 AS INT) AS r_len", "ovl_len AS len", "CAST(weight % 12 AS INT) AS mismatches",
        "CAST(src % 40 AS INT) AS q_start", "CAST(dst % 40 AS INT) AS r_start",
    )
    out = overlap.mirrored(overlap.typed(overlap.accept(aligned)))
    return out.withColumn("iden", F.round("iden", 6)).drop("reverse")


# The graph.

_INNER = "NOT s_contained AND NOT d_contained"


@query(
    sql(
        """SELECT src, dst, m.o AS ovl_len, m.i AS iden, s_contained, d_contained, m.r AND NOT s_contained AND NOT d_contained AS r_dovetail
        FROM (SELECT src, dst, max({'o': ovl_len, 'i': iden, 'r': r_dovetail}) AS m, bool_or(s_contained) AS s_contained, bool_or(d_contained) AS d_contained FROM raw_edges GROUP BY 1, 2)""",
        "raw_edges",
    )
)
def g1_g5_dedup_edges(spark, d):
    return graph.dedup_edges(inputs.raw_edges(spark, d))


@query(
    sql(
        f"""SELECT src, dst, CAST(sum(quantity) AS BIGINT) AS weight, bool_and(s_contained) AS s_contained, bool_and(d_contained) AS d_contained,
        coalesce(max({{'w': quantity, 'r': r_dovetail}}) FILTER (WHERE {_INNER}).r, false) AS r_dovetail FROM raw_edges GROUP BY 1, 2""",
        "raw_edges",
    ).replace("coalesce(max({'w': quantity, 'r': r_dovetail}) FILTER (WHERE NOT s_contained AND NOT d_contained).r, false)", "coalesce((max({'w': quantity, 'r': r_dovetail}) FILTER (WHERE NOT s_contained AND NOT d_contained)).r, false)")
)
def g6_sum_edges(spark, d):
    return graph.sum_edges(inputs.raw_edges(spark, d).withColumnRenamed("quantity", "weight"))


@query(sql("SELECT src, dst, weight, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS INT) AS rank FROM edges", "edges"))
def g2_g3_by_weight(spark, d):
    return graph.by_weight(inputs.edges(spark, d).select("src", "dst", "weight"))


@query(sql("SELECT node, n_den, e_den, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN (SELECT src AS node, count(*) AS degree FROM edges GROUP BY 1) USING (node)", "edges", "nodes"))
def g7_g11_degrees(spark, d):
    return graph.with_all_nodes(inputs.nodes(spark, d), inputs.edges(spark, d))


@query(sql("SELECT src, dst, weight FROM edges WHERE src NOT IN (SELECT node FROM nodes WHERE n_den = 1) AND dst NOT IN (SELECT node FROM nodes WHERE n_den = 1)", "edges", "nodes"))
def g10_without_nodes(spark, d):
    return graph.without_nodes(inputs.edges(spark, d), inputs.nodes(spark, d).filter("n_den = 1")).select("src", "dst", "weight")


@query(sql(", gone AS MATERIALIZED (SELECT DISTINCT src AS s, dst AS d FROM edges WHERE s_contained) SELECT src, dst, weight FROM edges LEFT JOIN gone ON src = s AND dst = d WHERE s IS NULL", "edges").replace(" , ", ", ", 1))
def g10_without_edges(spark, d):
    e = inputs.edges(spark, d)
    return graph.without_edges(e, e.filter("s_contained")).select("src", "dst", "weight")


_DAG = "g AS (SELECT a AS src, b AS dst, weight FROM co)"


@query(sql(f", {_DAG} SELECT src, dst, weight FROM g e WHERE NOT EXISTS (SELECT 1 FROM g x JOIN g y ON x.dst = y.src WHERE x.src = e.src AND y.dst = e.dst)", "edges").replace(" , ", ", ", 1))
def u4_transitive_reduction(spark, d):
    return graph.transitive_reduction(inputs.edges(spark, d).filter("src < dst").select("src", "dst", "weight"))


@query(sql(f"SELECT src, dst, weight, r_dovetail FROM (SELECT *, row_number() OVER (PARTITION BY src, r_dovetail ORDER BY weight DESC, dst) AS i FROM edges WHERE {_INNER}) WHERE i = 1", "edges"))
def u5_best_per_side(spark, d):
    return graph.best_per_side(inputs.edges(spark, d)).select("src", "dst", "weight", "r_dovetail")


@query(
    sql(
        """, inn AS (SELECT src AS node, count(*) AS n FROM edges WHERE NOT s_contained AND NOT d_contained GROUP BY 1)
        SELECT DISTINCT CASE WHEN s_contained AND d_contained THEN CASE WHEN coalesce(a.n, 0) < coalesce(b.n, 0) OR (coalesce(a.n, 0) = coalesce(b.n, 0) AND src < dst) THEN src ELSE dst END
        WHEN s_contained THEN src ELSE dst END AS node FROM edges e LEFT JOIN inn a ON a.node = e.src LEFT JOIN inn b ON b.node = e.dst WHERE s_contained OR d_contained""",
        "edges",
    ).replace(" , ", ", ", 1)
)
def u3_contained_nodes(spark, d):
    return graph.contained_nodes(inputs.edges(spark, d))


@query(sql("SELECT node, entropy FROM (SELECT src AS node, round(sum(p * ln(p)), 6) AS entropy FROM (SELECT src, weight / sum(weight) OVER (PARTITION BY src) AS p FROM edges) GROUP BY 1)", "edges"))
def a29_entropy(spark, d):
    return graph.entropy(inputs.edges(spark, d)).withColumn("entropy", F.round("entropy", 6))


@query(sql("SELECT src AS node, count(*) AS degree FROM edges GROUP BY 1 HAVING count(*) > 40", "edges"))
def t9_high_degree(spark, d):
    return graph.high_degree(inputs.edges(spark, d), 40)


@query(sql(", m AS (SELECT DISTINCT src AS node FROM edges WHERE s_contained) SELECT src, dst, ovl_len FROM edges WHERE src NOT IN (SELECT node FROM m) AND dst NOT IN (SELECT node FROM m)", "edges").replace(" , ", ", ", 1))
def t1_t6_surviving_edges(spark, d):
    e, n = inputs.edges(spark, d), inputs.nodes(spark, d)
    return contigs.surviving_edges(e, n.join(graph.mask_contained(e), "node", "left_anti"))


@query(sql("SELECT src // 2 AS src, dst // 2 AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM edges WHERE src // 2 <> dst // 2 GROUP BY 1, 2", "edges"))
def m6_contract(spark, d):
    up = inputs.level_map(spark, d).filter("level = 1").select("parent", "child")
    return graph.sum_edges(graph.contract(inputs.edges(spark, d), up)).select("src", "dst", "weight")


@query(sql("SELECT CAST(sum(weight) AS BIGINT) AS total, CAST(sum(CASE WHEN src % 4 <> dst % 4 THEN weight ELSE 0 END) AS BIGINT) AS cut FROM edges", "edges"))
def k8_edge_cut(spark, d):
    return graph.edge_cut(inputs.edges(spark, d), inputs.nodes(spark, d).select("node", (F.col("node") % 4).alias("part")))


@query(sql("SELECT CAST(sum(weight) AS BIGINT) AS cut FROM edges WHERE src % 4 = 0 AND dst % 4 = 1", "edges"))
def k7_bisection_cut(spark, d):
    return graph.bisection_cut(inputs.edges(spark, d), inputs.nodes(spark, d).select("node", (F.col("node") % 4).alias("part")))


@query(sql("SELECT node, 0 AS part FROM nodes", "nodes"))
def k1_initial_parts(spark, d):
    return partition.initial_parts(inputs.nodes(spark, d))


# Coarsening.


@query(sql("SELECT node, CASE WHEN node % 3 = 0 AND node > 1 THEN 0 ELSE 1 END :: BIGINT AS n_den, 0 :: BIGINT AS e_den FROM nodes", "nodes"))
def m1_initial_density(spark, d):
    return coarsen.initial_density(inputs.nodes(spark, d), _contain(spark, d))


@query(sql(", c AS (SELECT quantile_cont(weight, 0.25) AS a, quantile_cont(weight, 0.5) AS b, quantile_cont(weight, 0.75) AS c FROM edges) SELECT src, dst, CAST(weight > a AS INT) + CAST(weight > b AS INT) + CAST(weight > c.c AS INT) AS bin FROM edges, c", "edges").replace(" , ", ", ", 1))
def m2_weight_bins(spark, d):
    return coarsen.weight_bins(inputs.edges(spark, d)).select("src", "dst", "bin")


_ELIGIBLE = """el AS (SELECT a AS src, b AS dst, weight FROM co JOIN nodes s ON s.node = a JOIN nodes t ON t.node = b WHERE weight >= 20 AND
    CASE WHEN s.n_den + t.n_den = 1 THEN true WHEN s.n_den + t.n_den < 1 THEN false ELSE 2.0 * (s.e_den + t.e_den + weight) >= 5 * (s.n_den + t.n_den) * (s.n_den + t.n_den - 1) END)"""


@query(sql(f", {_ELIGIBLE} SELECT src, dst, weight FROM el", "edges", "nodes").replace(" , ", ", ", 1))
def m4_eligible_edges(spark, d):
    return coarsen.eligible(inputs.edges(spark, d), inputs.nodes(spark, d), 20, 5.0)


@query(sql(f", {_ELIGIBLE}, b AS (SELECT node, max(weight) AS w FROM (SELECT src AS node, weight FROM el UNION ALL SELECT dst, weight FROM el) GROUP BY 1) SELECT src, dst, weight FROM el JOIN b x ON x.node = src JOIN b y ON y.node = dst WHERE weight = x.w AND weight = y.w", "edges", "nodes").replace(" , ", ", ", 1))
def m3_heaviest_both_ways(spark, d):
    """Edges as heavy as any at either end: what a round of matching chooses from."""
    pairs = coarsen.eligible(inputs.edges(spark, d), inputs.nodes(spark, d), 20, 5.0)
    both = pairs.select(F.col("src").alias("node"), "weight").unionByName(pairs.select(F.col("dst").alias("node"), "weight")).groupBy("node").agg(F.max("weight").alias("w"))
    out = pairs.join(both.select(F.col("node").alias("src"), F.col("w").alias("x")), "src").join(both.select(F.col("node").alias("dst"), F.col("w").alias("y")), "dst")
    return out.filter("weight = x AND weight = y").select("src", "dst", "weight")


@query()
def m3_matching(spark, d):
    return coarsen.matching(coarsen.eligible(inputs.edges(spark, d), inputs.nodes(spark, d), 20, 5.0))


@query()
def m7_coarsened_nodes(spark, d):
    """Every level's nodes and densities."""
    levels = coarsen.coarsen(inputs.edges(spark, d).drop("ovl_len", "iden"), inputs.nodes(spark, d), 20, 1.0, 0.01)
    out = None
    for i, n in enumerate(levels.nodes):
        n = n.select(F.lit(i).alias("level"), "node", "n_den", "e_den")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT p_partkey >> 6 AS cluster, CAST(row_number() OVER (PARTITION BY p_partkey >> 6 ORDER BY p_partkey) - 1 AS INT) AS pos, p_partkey AS read_id FROM part")
def m8_recovered_clusters(spark, d):
    return coarsen.cluster_order(coarsen.recover_clusters(inputs.level_map(spark, d), 6))


@query("SELECT p_partkey AS read_id, row_number() OVER (ORDER BY p_partkey >> 6, p_partkey) - 1 AS rank FROM part")
def m9_final_order(spark, d):
    return coarsen.final_order(coarsen.cluster_order(coarsen.recover_clusters(inputs.level_map(spark, d), 6)))


_ORDER = "o AS (SELECT node, row_number() OVER (ORDER BY n_den, node) - 1 AS rank FROM nodes)"


@query(sql(f", {_ORDER} SELECT a.rank AS src, b.rank AS dst, weight, iden FROM edges JOIN o a ON a.node = src JOIN o b ON b.node = dst", "edges", "nodes").replace(" , ", ", ", 1))
def m10_m11_final_edges(spark, d):
    n = inputs.nodes(spark, d)
    clusters = n.select(F.col("n_den").alias("cluster"), F.expr("row_number() OVER (PARTITION BY n_den ORDER BY node) - 1").alias("pos"), F.col("node").alias("read_id"))
    return coarsen.final_edges(inputs.edges(spark, d), coarsen.final_order(clusters)).select("src", "dst", "weight", "iden")


# Refinement.


@query(sql(f", r AS (SELECT CAST(row_number() OVER (ORDER BY n_den * 100 + e_den DESC, node) - 1 AS BIGINT) AS i, node, n_den * 100 + e_den AS size FROM nodes) SELECT node AS cluster, size, CAST(CASE WHEN (i // 7) % 2 = 0 THEN i % 7 ELSE 6 - i % 7 END AS INT) AS bin FROM r", "nodes").replace(" , ", ", ", 1))
def u2_balanced_bins(spark, d):
    return refine.balanced_bins(inputs.nodes(spark, d).select(F.col("node").alias("cluster"), (F.col("n_den") * 100 + F.col("e_den")).alias("size")), 7)


@query(sql(", w AS (SELECT doc_id AS contig, dna AS seq FROM d WHERE length(dna) > 0) SELECT contig, CAST(i AS INT) AS section, substr(seq, CAST(i * 500 + 1 AS INT), 500) AS seq FROM (SELECT contig, seq, unnest(range(0, CAST(ceil(length(seq) / 500.0) AS BIGINT))) AS i FROM w)", "reads").replace(" , ", ", ", 1))
def u15_sections(spark, d):
    dna_ = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), inputs.LETTERS, inputs.BASES)
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("contig"), dna_.alias("seq"))
    return refine.sections(rows.withColumn("flags", F.expr("repeat('$', length(seq))"))).select("contig", "section", "seq")


@query(sql("SELECT n_den AS node, CAST(sum(n_den) AS BIGINT) AS n_den FROM nodes GROUP BY n_den", "nodes"))
def u13_hybrid_nodes(spark, d):
    n = inputs.nodes(spark, d)
    return refine.hybrid_nodes(n, n.select(F.col("n_den").alias("parent"), F.col("node").alias("child")))


@query(sql(", o AS (SELECT src // 16 AS cluster, dst // 4 AS contig, min(dst) AS pos FROM edges GROUP BY 1, 2) SELECT cluster, pos, contig FROM o", "edges").replace(" , ", ", ", 1))
def u16_contig_clusters(spark, d):
    e = inputs.edges(spark, d).selectExpr("src DIV 16 AS cluster", "dst AS read_id", "dst AS pos").distinct()
    places = inputs.nodes(spark, d).selectExpr("node AS read_id", "node DIV 4 AS contig")
    return refine.contig_clusters(e, places)


# Analysis.


@query(sql("SELECT round(2.0 * e / n, 6) AS avg_degree, round(l * 1.0 / n, 6) AS len_per_node, round(l * 1.0 / e, 6) AS len_per_edge, round(i / n, 6) AS iden_per_node, round(i / e, 6) AS iden_per_edge FROM (SELECT count(*) AS e, sum(ovl_len) AS l, sum(iden) AS i FROM edges), (SELECT count(*) AS n FROM nodes)", "edges", "nodes"))
def a1_a3_graph_averages(spark, d):
    out = analyze.graph_averages(inputs.edges(spark, d), inputs.nodes(spark, d))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(sql("SELECT round(sum(length(seq) - length(translate(seq, 'GC', ''))) * 1.0 / sum(length(seq)), 6) AS gc FROM reads", "reads"))
def a4_gc_content(spark, d):
    return analyze.gc_content(inputs.reads(spark, d)).select(F.round("gc", 6).alias("gc"))


_DENSITY = "CASE WHEN n_den > 1 THEN 2.0 * e_den / (n_den * (n_den - 1)) ELSE 0.0 END"


@query(sql(f"SELECT round(avg({_DENSITY}), 6) AS avg_density FROM nodes", "nodes"))
def a5_average_density(spark, d):
    return analyze.average_density(inputs.nodes(spark, d)).select(F.round("avg_density", 6).alias("avg_density"))


@query(sql("SELECT round(avg(n_den), 6) AS avg_size FROM nodes", "nodes"))
def a6_average_size(spark, d):
    return analyze.average_size(inputs.nodes(spark, d)).select(F.round("avg_size", 6).alias("avg_size"))


def _members(spark, d):
    return inputs.reads(spark, d).select(F.col("doc_id").alias("cluster"), "read_id")


@query(sql("SELECT doc_id AS cluster, round(sum(length(seq) - length(translate(seq, 'GC', ''))) * 1.0 / sum(length(seq)), 6) AS value FROM reads GROUP BY 1 HAVING sum(length(seq) - length(translate(seq, 'GC', ''))) * 1.0 / sum(length(seq)) >= 0.5", "reads"))
def a7_a24_cluster_gc(spark, d):
    r = inputs.reads(spark, d)
    return analyze.cluster_gc(r.select(F.col("doc_id").alias("cluster"), "read_id"), r.select("read_id", "seq"), least=0.5).withColumn("value", F.round("value", 6))


@query(sql(f"SELECT node AS cluster, round({_DENSITY}, 6) AS value FROM nodes WHERE {_DENSITY} < 10", "nodes"))
def a9_a10_cluster_density(spark, d):
    return analyze.cluster_density(inputs.nodes(spark, d), below=10).withColumn("value", F.round("value", 6))


@query(sql("SELECT node AS cluster, n_den AS value FROM nodes WHERE n_den >= 2", "nodes"))
def a11_a12_cluster_size(spark, d):
    return analyze.cluster_size(inputs.nodes(spark, d), least=2)


def _groups(spark, d):
    return inputs.nodes(spark, d).selectExpr("node DIV 16 AS cluster", "node AS read_id")


@query(sql(", g AS (SELECT src, count(*) AS n FROM edges GROUP BY 1) SELECT node // 16 AS cluster, round(avg(coalesce(n, 0)), 6) AS value FROM nodes LEFT JOIN g ON src = node GROUP BY 1", "edges", "nodes").replace(" , ", ", ", 1))
def a13_a14_child_degree(spark, d):
    return analyze.child_degree(_groups(spark, d), inputs.edges(spark, d)).withColumn("value", F.round("value", 6))


@query(sql("SELECT src AS cluster, count(*) AS value FROM edges GROUP BY 1 HAVING count(*) >= 20", "edges"))
def a15_a16_node_degree(spark, d):
    return analyze.node_degree(inputs.edges(spark, d), least=20)


@query(sql("SELECT src // 16 AS cluster, round(avg(iden), 6) AS value FROM edges GROUP BY 1", "edges"))
def a17_a18_cluster_identity(spark, d):
    return analyze.cluster_identity(_groups(spark, d), inputs.edges(spark, d)).withColumn("value", F.round("value", 6))


@query(sql("SELECT src // 16 AS cluster, round(avg(ovl_len), 6) AS value FROM edges GROUP BY 1", "edges"))
def a19_a20_cluster_overlap(spark, d):
    return analyze.cluster_overlap(_groups(spark, d), inputs.edges(spark, d)).withColumn("value", F.round("value", 6))


@query(sql("SELECT src, dst, weight FROM edges WHERE src = 7", "edges"))
def a21_neighbours(spark, d):
    return graph.neighbours(inputs.edges(spark, d), 7).select("src", "dst", "weight")


@query(sql("SELECT level, parent, child FROM level_map WHERE level = 3", "level_map"))
def a22_children(spark, d):
    return analyze.children(inputs.level_map(spark, d), 3)


@query(
    sql(
        """, w AS (SELECT doc_id AS cluster, substr(seq, CAST(i AS INT), 4) AS w FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - 2)) AS i FROM reads)),
        n AS (SELECT cluster, (instr('ACGT', w[1]) - 1) * 64 + (instr('ACGT', w[2]) - 1) * 16 + (instr('ACGT', w[3]) - 1) * 4 + instr('ACGT', w[4]) - 1 AS tetramer, count(*) AS n FROM w GROUP BY 1, 2)
        SELECT cluster, CAST(tetramer AS BIGINT) AS tetramer, n, round(n * 1.0 / sum(n) OVER (PARTITION BY cluster), 6) AS share FROM n""",
        "reads",
    ).replace(" , ", ", ", 1)
)
def a25_tetramers(spark, d):
    r = inputs.reads(spark, d)
    return analyze.tetramers(r.select(F.col("doc_id").alias("cluster"), "read_id"), r.select("read_id", "seq")).withColumn("share", F.round("share", 6))


@query(sql(", r AS (SELECT src AS cluster, sum(weight) AS value, row_number() OVER (ORDER BY sum(weight), src) - 1 AS rank FROM edges GROUP BY 1) SELECT cluster, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r, (SELECT count(*) AS n FROM r) WHERE rank >= 0.25 * n AND rank <= 0.75 * n", "edges").replace(" , ", ", ", 1))
def a26_rank_between(spark, d):
    values = inputs.edges(spark, d).groupBy(F.col("src").alias("cluster")).agg(F.sum("weight").alias("value"))
    return analyze.rank_between(values, 0.25, 0.75)


@query(sql(", b AS (SELECT src % 16 AS bin, sum(weight) AS load FROM edges GROUP BY 1) SELECT count(*) AS bins, round(avg(load), 6) AS mean, round(var_pop(load), 4) AS variance FROM b", "edges").replace(" , ", ", ", 1))
def a28_bin_loads(spark, d):
    out = analyze.bin_loads(inputs.edges(spark, d).select((F.col("src") % 16).alias("bin"), F.col("weight").alias("size")))
    return out.select("bins", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query(sql("SELECT doc_id AS cluster, string_agg(seq, '*' ORDER BY read_id) AS seqs FROM reads GROUP BY 1", "reads"))
def a27_cluster_dump(spark, d):
    r = inputs.reads(spark, d)
    dump = analyze.cluster_dump(r.select(F.col("doc_id").alias("cluster"), "read_id"), r.select("read_id", F.concat(F.lit("r"), "read_id").alias("label"), "seq"))
    return dump.select("cluster", F.array_join("seqs", "*").alias("seqs"))


@query(sql("SELECT '>contig' || node || ' ' || n_den || chr(10) || repeat('ACGT', CAST(n_den AS INT)) AS value FROM nodes", "nodes"))
def t2_contig_fasta(spark, d):
    return contigs.contig_fasta(inputs.nodes(spark, d).select(F.col("node").alias("contig"), "n_den", F.expr("repeat('ACGT', CAST(n_den AS INT))").alias("seq")))


# What SQL can't tell: aligned overlaps, and what is built on them.


def _read_set(spark, d):
    return inputs.reads(spark, d).filter("length(seq) >= 75").select("read_id", "seq")


@query()
def j10_j16_overlaps(spark, d):
    """The overlap graph of all reads: chained, filtered, aligned, typed and mirrored."""
    return overlap.overlaps(_read_set(spark, d))


def _heaviest_forward(spark, d):
    """Each node's heaviest forward edge: a graph with many unbranched stretches."""
    return graph.by_weight(inputs.edges(spark, d).filter("src < dst")).filter("rank = 1").select("src", "dst")


@query(sql(", g AS (SELECT a AS src, b AS dst FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS i FROM co) WHERE i = 1), o AS (SELECT src FROM g GROUP BY 1 HAVING count(*) = 1), i AS (SELECT dst FROM g GROUP BY 1 HAVING count(*) = 1) SELECT src, dst FROM g WHERE src IN (FROM o) AND dst IN (FROM i)", "edges").replace(" , ", ", ", 1))
def t7_unbranched_links(spark, d):
    return graph._links(_heaviest_forward(spark, d))


@query()
def u9_t7_maximal_paths(spark, d):
    return graph.maximal_paths(_heaviest_forward(spark, d), inputs.nodes(spark, d))


@query()
def k2_k6_partitions(spark, d):
    """Four parts of every level of the coarsened graph."""
    levels = coarsen.coarsen(inputs.edges(spark, d).drop("ovl_len", "iden"), inputs.nodes(spark, d), 20, 1.0, 0.01)
    out = None
    for i, p in enumerate(partition.distribute(levels, 4)):
        p = p.select(F.lit(i).alias("level"), "node", F.col("part").cast("long").alias("part"))
        out = p if out is None else out.unionByName(p)
    return out
