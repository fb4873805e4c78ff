"""Reads and graphs made of the driver's tables, in Spark; `SQL` says the same for DuckDB.

Reads: a document's letters, folded to four bases, in tiles of 150; all of every text. Edges: parts that follow each other
in an order, in both directions, whose weight is the quantity bought; the other attributes follow from the ids. A node's
densities follow from its part's size. Levels: halves of the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = ("ACGT" * 7)[:26]
TILE = 150
LEVELS = 12

SQL = {
    "reads": f"""
        d AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') AS dna FROM documents),
        reads AS (SELECT doc_id, doc_id * 100000 + i AS read_id, substr(dna, CAST(i * {TILE} + 1 AS INT), {TILE}) AS seq
                  FROM (SELECT doc_id, dna, unnest(range(0, CAST(ceil(length(dna) / {TILE}.0) AS BIGINT))) AS i FROM d))""",
    "pairs": """
        l AS (SELECT l_orderkey, l_partkey, l_quantity, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nxt FROM lineitem),
        pairs AS (SELECT l_orderkey, least(l_partkey, nxt) AS a, greatest(l_partkey, nxt) AS b, CAST(l_quantity AS BIGINT) AS quantity FROM l WHERE nxt IS NOT NULL AND l_partkey <> nxt)""",
    "raw_edges": """
        raw_edges AS (SELECT a AS src, b AS dst, quantity, CAST(50 + quantity * 2 AS INT) AS ovl_len, 90 + (l_orderkey % 21) / 2.0 AS iden,
                             (l_orderkey + a) % 13 = 0 AS s_contained, (l_orderkey + b) % 13 = 0 AS d_contained, l_orderkey % 2 = 0 AS r_dovetail FROM pairs)""",
    "edges": """
        co AS (SELECT a, b, CAST(sum(quantity) AS BIGINT) AS weight FROM pairs GROUP BY 1, 2),
        both_ways AS (SELECT a AS src, b AS dst, weight FROM co UNION ALL SELECT b, a, weight FROM co),
        edges AS (SELECT src, dst, weight, CAST(50 + weight % 100 AS INT) AS ovl_len, 90 + ((src + dst) * 7 % 21) / 2.0 AS iden,
                         (src * 31 + dst) % 13 = 0 AS s_contained, (dst * 31 + src) % 13 = 0 AS d_contained,
                         src < dst AND (src * 31 + dst) % 13 <> 0 AND (dst * 31 + src) % 13 <> 0 AS r_dovetail FROM both_ways)""",
    "nodes": "nodes AS (SELECT p_partkey AS node, CAST(1 + p_size % 3 AS BIGINT) AS n_den, CAST(p_size AS BIGINT) AS e_den FROM part)",
    "level_map": f"level_map AS (SELECT DISTINCT CAST(lv AS INT) AS level, p_partkey >> lv AS parent, p_partkey >> (lv - 1) AS child FROM part, range(1, {LEVELS + 1}) AS t(lv))",
}
NEEDS = {"raw_edges": ("pairs",), "edges": ("pairs",)}


def sql(query: str, *names: str) -> str:
    """A query for DuckDB over some of the inputs."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    return "WITH " + ",".join(SQL[n] for n in order) + " " + query


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, read_id, seq."""
    dna = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, BASES)
    docs = _table(spark, folder, "documents").select("doc_id", dna.alias("dna")).filter("length(dna) > 0")
    tiles = docs.select("doc_id", "dna", F.explode(F.sequence(F.lit(0), F.floor((F.length("dna") - 1) / TILE).cast("int"))).alias("i"))
    return tiles.select("doc_id", (F.col("doc_id") * 100000 + F.col("i")).alias("read_id"), F.expr(f"substring(dna, i * {TILE} + 1, {TILE})").alias("seq"))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    items = _table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.expr("lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)").alias("nxt"))
    return items.filter("nxt IS NOT NULL AND l_partkey <> nxt").select("l_orderkey", F.least("l_partkey", "nxt").alias("a"), F.greatest("l_partkey", "nxt").alias("b"), F.col("l_quantity").cast("long").alias("quantity"))


def raw_edges(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).selectExpr(
        "a AS src", "b AS dst", "quantity", "CAST(50 + quantity * 2 AS INT) AS ovl_len", "90 + (l_orderkey % 21) / 2D AS iden",
        "(l_orderkey + a) % 13 = 0 AS s_contained", "(l_orderkey + b) % 13 = 0 AS d_contained", "l_orderkey % 2 = 0 AS r_dovetail",
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    co = pairs(spark, folder).groupBy("a", "b").agg(F.sum("quantity").alias("weight"))
    both = co.select("weight", F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))))
    return both.selectExpr(
        "src", "dst", "weight", "CAST(50 + weight % 100 AS INT) AS ovl_len", "90 + ((src + dst) * 7 % 21) / 2D AS iden",
        "(src * 31 + dst) % 13 = 0 AS s_contained", "(dst * 31 + src) % 13 = 0 AS d_contained",
        "src < dst AND (src * 31 + dst) % 13 <> 0 AND (dst * 31 + src) % 13 <> 0 AS r_dovetail",
    )


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "part").selectExpr("p_partkey AS node", "CAST(1 + p_size % 3 AS BIGINT) AS n_den", "CAST(p_size AS BIGINT) AS e_den")


def level_map(spark: SparkSession, folder: str) -> DataFrame:
    parts = _table(spark, folder, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("level"))
    return parts.selectExpr("level", "shiftright(p_partkey, level) AS parent", "shiftright(p_partkey, level - 1) AS child").distinct()
