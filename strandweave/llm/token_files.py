"""Token ids in files of patched frame-of-reference blocks.

A file is a Parquet row group container, so that any store Spark reads can hold it; each row is one segment of whole
documents in ascending doc_id order. A segment's payload, all numbers little-endian:

    "PFR1" | u32 ids | u32 blocks | u32 block length | u32 start of each block and of the end | blocks
    block: u32 minimum | u8 width | u16 exceptions | packed low bits | u16 place of each exception | u32 its value

A block's minimum is subtracted, what is left is packed at the width that `percentile` of its values fit in, and the
full values of the others stand in the exception list.

Defined cases: a null text is the empty one and has the end id alone; rows of one doc_id follow each other in the order
of their texts; an empty table gives empty files; null doc_ids come first; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

BLOCK = 256
SEGMENT = 1 << 18
FILE = "part int, segment int, first long, doc_ids array<long>, lengths array<long>, payload binary"
_HEAD = struct.Struct("<IBH")


def pack(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """The payload for the ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.empty(blocks * BLOCK, np.uint32)
    values[:n] = ids
    values[n:] = ids[-1] if n else 0
    values = values.reshape(blocks, BLOCK)
    low = values.min(axis=1) if blocks else np.zeros(0, np.uint32)
    values = values - low[:, None]
    bits = np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # bit length
    width = np.partition(bits, int(percentile * (BLOCK - 1)), axis=1)[:, int(percentile * (BLOCK - 1))]
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for i in range(0, len(rows) if w else 0, 1024):
            part = rows[i : i + 1024]
            raw = (values[part][:, :, None] >> np.arange(w, dtype=np.uint32) & 1).astype(np.uint8)
            raw = np.packbits(raw.reshape(len(part), -1), axis=1, bitorder="little").tobytes()
            size = BLOCK * int(w) // 8
            for k, r in enumerate(part.tolist()):
                packed[r] = raw[k * size : (k + 1) * size]
    where = np.nonzero(bits > width[:, None])
    counts = np.bincount(where[0], minlength=blocks)
    place, value = where[1].astype("<u2").tobytes(), values[where].astype("<u4").tobytes()
    out, starts, at, done = [], [], 16 + 4 * (blocks + 1), 0
    for b, (m, w, k) in enumerate(zip(low.tolist(), width.tolist(), counts.tolist(), strict=True)):
        starts.append(at)
        out += [_HEAD.pack(m, w, k), packed[b], place[2 * done : 2 * (done + k)], value[4 * done : 4 * (done + k)]]
        at += 7 + len(packed[b]) + 6 * k
        done += k
    index = np.array([*starts, at], "<u4").tobytes()
    return b"".join([b"PFR1", struct.pack("<III", n, blocks, BLOCK), index, *out])


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a payload; with `first` and `last`, of those blocks alone, found through the index."""
    if payload[:4] != b"PFR1":
        raise ValueError("not a segment of this format")
    n, blocks, block = struct.unpack_from("<III", payload, 4)
    last = blocks if last is None else min(last, blocks)
    first = min(first, last)
    starts = np.frombuffer(payload, "<u4", blocks + 1, 16).astype(np.int64)[first:last]
    raw = np.frombuffer(payload, np.uint8)
    head = raw[starts[:, None] + np.arange(7)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width, count = head[:, 4].astype(np.int64), np.ascontiguousarray(head[:, 5:7]).view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((last - first, block), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        for i in range(0, len(rows), 1024):
            part = rows[i : i + 1024]
            bits = np.unpackbits(raw[starts[part][:, None] + 7 + np.arange(block * w // 8)], axis=1, bitorder="little")
            value = np.zeros((len(part), block), np.uint32)
            bits = bits.reshape(len(part), block, w)
            for k in range(w):
                value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
            out[part] = value
    for b in np.flatnonzero(count).tolist():
        at, k = int(starts[b]) + 7 + block * int(width[b]) // 8, int(count[b])
        out[b, np.frombuffer(payload, "<u2", k, at)] = np.frombuffer(payload, "<u4", k, at + 2 * k)
    out += low[:, None]
    return out.ravel()[: max(0, min(n, last * block) - first * block)]


def _writer(tokenizer: str, end_id: int, percentile: float):
    def write(batches):
        encode, end = tokens.encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        ids, doc_ids, lengths, size, first, segment = [], [], [], 0, 0, 0

        def close():
            payload = pack(np.frombuffer(b"".join(ids), "<u4"), percentile)
            columns = [[part], [segment], [first], [doc_ids], [lengths], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "segment", "first", "doc_ids", "lengths", "payload"])

        for rows in common.slices(batches, 2_500_000):
            for d, x in zip(rows.column("doc_id").to_pylist(), encode(rows.column("text").to_pylist()), strict=True):
                ids += [x, end]
                doc_ids.append(d)
                lengths.append(len(x) // 4 + 1)
                size += lengths[-1]
                if size >= SEGMENT:
                    yield close()
                    first, segment = first + size, segment + 1
                    ids, doc_ids, lengths, size = [], [], [], 0
        if ids:
            yield close()

    return write


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, percentile: float = 0.9) -> None:
    """Write every row's ids, in ascending doc_id order: file by file, segment by segment.

    The texts are range-partitioned before they are encoded: they move once, and ids never move.
    """
    rows = common.columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.repartitionByRange(common.partitions(docs.sparkSession), "doc_id", F.xxhash64("text"))
    rows = rows.sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_writer(tokenizer, end_id, percentile), FILE).write.option("compression", "none").parquet(path)


def _read(batches):
    for b in batches:
        for part, first, doc_ids, lengths, payload in zip(*(b.column(c).to_pylist() for c in ("part", "first", "doc_ids", "lengths", "payload")), strict=True):
            ids = unpack(payload).astype("<u4").tobytes()
            ends = np.cumsum([0, *lengths]).tolist()
            crc = [zlib.crc32(memoryview(ids)[4 * i : 4 * j]) for i, j in zip(ends, ends[1:], strict=False)]
            names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
            values = [[part] * len(crc), doc_ids, [first + i for i in ends[:-1]], lengths, crc]
            yield pa.record_batch([pa.array(v, pa.int32() if n == "part" else pa.int64()) for n, v in zip(names, values, strict=True)], names)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    Only each file's number of ids goes to the driver: a row for each partition of the writer, however large the input.
    """
    files = spark.read.schema(FILE).parquet(path)
    sizes = files.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before, bases = 0, []
    for part, n in sorted((r.part, r.n) for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        bases.append((part, before))
        before += n
    docs = files.mapInArrow(_read, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    base = spark.createDataFrame(bases, "part int, base long")
    return docs.join(F.broadcast(base), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
