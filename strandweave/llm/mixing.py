"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end; the row of words is cut into blocks of equal size.
A slot i of the schedule has the point frac(i x golden ratio), which falls into a source's interval of the cumulative
weights; the slot's rank among its source's slots, modulo the source's blocks, names the block that it takes. A document
gives the mix the words that its blocks' slots cover, so often as they are taken.

A source has at least 256 blocks, or as many as words (with more than 4096 sources, at least 2**20 blocks over all). The
points give a source a few slots more or less than it needs: slots beyond its need are dropped, missing ones are appended
at the end, and the last one ends at the word where the source's target, rounded, is met.

Only one row for each source comes to the driver. A source's row of words is summed in two levels, by 1024 ranges of the
hash, so that a source with most of the rows is spread over many tasks.

Defined cases: a null text has size 0 and gives 0 words; null sources are one source, the last; repeated rows are
documents of their own; an empty table gives an empty result; columns besides doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

RANGES = 1024
#: floor(2**32 / golden ratio), made odd: i times this modulo 2**32 is the golden-ratio sequence in 32-bit fixed point.
GOLDEN = 2654435769
CHUNK = 1 << 16
#: Least blocks of a source, and of all sources together where there are very many.
LEAST, LEAST_ALL = 256, 1 << 20


def targets(sizes: list[int], weights: list[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Words for each source: by weight, but none above `cap` times its size; what is above is reshared by weight."""
    left, open_ = share * sum(sizes), [i for i, s in enumerate(sizes) if s]
    out = [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _sources(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float, slots: int, largest: int) -> list[dict]:
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    goals = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, cap)
    block = min(largest, max(1.0, sum(goals) / slots))
    least = max(1, min(LEAST, LEAST_ALL // max(1, len(found))))
    out = []
    for i, (r, goal) in enumerate(zip(found, goals, strict=True)):
        size = r["size"]
        blocks = max(1, round(size / block), min(size, least))
        # Whole passes, and the last one up to a word `cut`; `needed` slots hold them.
        whole, cut = divmod(round(goal), size) if size else (0, 0)
        needed = whole * blocks - (-cut * blocks // size) if size else 0
        out.append({"key": i, "source": r.source, "source_size": size, "target": goal, "blocks": blocks, "needed": needed, "cut": cut})
    return out


def schedule(spark, sources: list[dict]) -> DataFrame:
    """slot, key (of the source), rank, block, cut. Ranks are counted within chunks of slots, then across chunks.

    Each source has just the slots that it needs. `cut` is the word at which a source's last slot ends, if not its block's end.
    """
    slots = sum(s["needed"] for s in sources)
    ends, end = [], 0
    for s in sources:
        end += s["needed"]
        ends.append(end / max(slots, 1))
    frame = spark.range(slots, numPartitions=max(1, min(common.partitions(spark), slots // CHUNK + 1))).withColumnRenamed("id", "slot")
    point = F.pmod((F.col("slot") + 1) * GOLDEN, F.lit(1 << 32)) / float(1 << 32)
    passed = F.aggregate(F.array(*map(F.lit, ends[:-1] or [2.0])), F.lit(0), lambda a, x: a + (x <= point).cast("int"))
    frame = frame.select("slot", passed.alias("key"), F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = frame.groupBy("key", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("key", "chunk", (F.sum("n").over(Window.partitionBy("key").orderBy("chunk")) - F.col("n")).alias("before"))
    frame = frame.withColumn("rank", F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")) - 1)
    shape = spark.createDataFrame([(s["key"], s["blocks"], s["needed"], s["cut"]) for s in sources], "key int, blocks long, needed long, cut long")
    frame = frame.join(before, ["key", "chunk"]).select("slot", "key", (F.col("rank") + F.col("before")).alias("rank"))
    frame = frame.join(shape, "key").filter("rank < needed")
    given = shape.join(counts.groupBy("key").agg(F.sum("n").alias("given")), "key", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    missing = given.filter("given < needed").withColumn("rank", F.explode(F.sequence("given", F.col("needed") - 1)))
    frame = frame.select("slot", "key", "rank", "blocks", "needed", "cut").unionByName(missing.select((F.col("rank") + slots).alias("slot"), "key", "rank", "blocks", "needed", "cut"))
    last = F.when((F.col("cut") > 0) & (F.col("rank") == F.col("needed") - 1), F.col("cut"))
    return frame.select("slot", "key", "rank", (F.col("rank") % F.col("blocks")).alias("block"), last.alias("cut"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, slots: int = 1 << 16, largest: int = 1 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, and the columns named in `carry`.

    `slots` is about how many blocks the mix has; no block is larger than `largest` words, so very large inputs have more.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), *carry, F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"))
    rows = common.stored(rows, "mix-sizes")  # texts are read once; what follows moves numbers
    sources = _sources(rows, weights, share, cap, slots, largest)
    if not sources:
        return rows.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), *carry)
    shape = spark.createDataFrame([tuple(s[c] for c in ("key", "source", "source_size", "target", "blocks")) for s in sources], "key int, source string, source_size long, target double, blocks long")
    rows = rows.join(shape, rows["source"].eqNullSafe(shape["source"])).drop("source")
    rows = rows.withColumn("_mixed", F.xxhash64("doc_id", "key"))
    rows = rows.withColumn("_range", F.shiftrightunsigned("_mixed", 54).cast("int"))
    sums = rows.groupBy("key", "_range").agg(F.sum("size").alias("n"))
    sums = sums.select("key", "_range", (F.sum("n").over(Window.partitionBy("key").orderBy("_range")) - F.col("n")).alias("before"))
    w = Window.partitionBy("key", "_range").orderBy("_mixed", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = rows.withColumn("first", F.sum("size").over(w) - F.col("size")).join(sums, ["key", "_range"])
    laid = laid.withColumn("first", F.col("first") + F.col("before"))
    # Block b of a source of S words has those from floor(b S / blocks); the blocks that a document meets, and where.
    b, size, whole = F.col("blocks"), F.col("size"), F.col("source_size")
    at = lambda word: F.floor(((word + 1) * b - 1) / whole)
    touched = F.when(size > 0, F.sequence(F.greatest(at(F.col("first")) - 1, F.lit(0)), F.least(at(F.col("first") + size - 1) + 1, b - 1)))
    laid = laid.withColumn("_row", F.struct("key", "_range", "_mixed", "first"))
    pieces = laid.select("_row", "key", "first", "size", "source_size", "blocks", F.explode(touched).alias("block"))
    low, high = F.floor(F.col("block") * whole / b), F.floor((F.col("block") + 1) * whole / b)
    pieces = pieces.select("_row", "key", "block", F.greatest(low, F.col("first")).alias("low"), F.least(high, F.col("first") + size).alias("high")).filter("low < high")
    times = schedule(spark, sources).groupBy("key", "block").agg(F.count_if(F.col("cut").isNull()).alias("times"), F.max("cut").alias("cut"))
    words = (F.col("high") - F.col("low")) * F.col("times") + F.greatest(F.least("high", "cut") - F.col("low"), F.lit(0)) * F.when(F.col("cut").isNull(), 0).otherwise(1)
    taken = pieces.join(times, ["key", "block"]).groupBy("_row").agg(F.sum(words).alias("taken"))
    # A document without words shares its place with the one that follows it, and takes nothing.
    out = laid.join(taken, "_row", "left").withColumn("taken", F.when(size > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "taken", *carry)


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves: a row for each whole time a document is taken, and one with the words of the rest.

    The last pass over a source takes the blocks from its first on, so that at most one document of a source is taken in
    part, and from its start: to the end of the last word taken, with the white space before and between its words.
    """
    # A row is named by its id and a hash of its text and source; rows that agree in all share evenly what they are given.
    text, source = F.col("row.text").cast("string").alias("text"), F.col("row.source").cast("string").alias("source")
    keyed = common.packed(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), text, source)
    keyed = keyed.withColumn("h", F.xxhash64("text", "source", F.col("source").isNull()))
    mixed = mix(keyed.drop("row"), carry=("h",), **how).groupBy(F.col("doc_id").alias("id2"), F.col("h").alias("h2"))
    mixed = mixed.agg(F.floor(F.sum("taken") / F.count("*")).alias("taken"), F.first("size").alias("size")).filter("taken > 0")
    rest, full = F.col("taken") % F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("int")
    copies = F.array_repeat(F.lit(-1).cast("long"), full)
    mixed = mixed.select("id2", "h2", F.when(rest > 0, F.array_append(copies, rest)).otherwise(copies).alias("copies"))
    rows = keyed.join(mixed.hint("shuffle_hash"), (F.col("h") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("id2")))
    word = common.WORD.replace("\\", "\\\\")
    space = word.replace("[^", "[").rstrip("+") + "*"
    cut = F.expr(f"array_join(slice(regexp_extract_all(text, '{space}{word}', 0), 1, cast(words AS int)), '')")
    rows = rows.select("row", "text", F.explode("copies").alias("words"))
    row = F.col("row").withField("text", cut)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(cut).cast(docs.schema["n_chars"].dataType))
    return rows.select(F.when(F.col("words") < 0, F.col("row")).otherwise(row).alias("row")).select("row.*")
