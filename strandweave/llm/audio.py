"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording is cut into overlapping frames; a frame's spectrum is summed by pitch class. Filters compare sums of areas of
the resulting picture, through its integral image, at every frame; each gives two bits, and all of them one packed
32-bit integer. Two recordings are aligned at the offset that most of their equal integers agree on, and linked if few
bits differ where they overlap.

Candidates follow from the link rule, by prefixes. An integer's first, second and further occurrences in a recording are
tokens of their own, so two recordings with 8 equal integers at an offset share 8 tokens. Of the tokens that a recording
shares with any other, in one order for all from the rarest to the commonest, all but the last 7 are its keys: two recordings
that share 8 tokens share a key, at every length. Each recording is first aligned with the leader of each of its keys,
which settles a key of two; of a longer one whose recordings are then still in different components, blocks of 64 meet blocks
of 64, and the pairs that share 8 tokens are aligned.

Defined cases: null audio, and audio shorter than a fingerprint's first window, has no integers and is linked with
nothing; a trailing odd byte is left out; repeated rows are recordings of their own with equal fingerprints; an empty
table gives an empty result; columns besides media_id, audio and rate are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graphs import components

FRAME, HOP, SPAN = 1024, 256, 16
BLOCK = 64
THRESHOLDS = (-0.15, 0.0, 0.15)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters() -> list[tuple[int, int, int]]:
    """(kind, first pitch class, pitch classes) by rule: each kind at four heights, moved around the octave."""
    return [(i % 4, 5 * i % (13 - (3, 4, 6, 12)[i // 4]), (3, 4, 6, 12)[i // 4]) for i in range(16)]


def pitch_classes(rate: int) -> np.ndarray:
    """(bins, 12): to which pitch class a spectrum's bin adds, between 55 and 3520 Hz."""
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(hertz), 12))
    heard = np.flatnonzero((hertz >= 55) & (hertz <= min(3520, rate / 2)))
    out[heard, np.round(12 * np.log2(hertz[heard] / 440)).astype(int) % 12] = 1
    return out


def fingerprint(audio: bytes | None, rate: int, classes: np.ndarray | None = None) -> np.ndarray:
    """The packed integers of 16-bit mono PCM."""
    samples = np.frombuffer(audio or b"", "<i2", len(audio or b"") // 2).astype(np.float64) / 32768
    frames = 1 + (len(samples) - FRAME) // HOP
    if frames < SPAN:
        return np.zeros(0, np.uint32)
    picture = np.empty((frames, 12))
    window, classes = np.hanning(FRAME), pitch_classes(rate) if classes is None else classes
    cut = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for i in range(0, frames, 4096):
        picture[i : i + 4096] = np.abs(np.fft.rfft(cut[i : i + 4096] * window, axis=1)) ** 2 @ classes
    picture /= np.maximum(np.linalg.norm(picture, axis=1, keepdims=True), 1e-9)
    whole = np.zeros((frames + 1, 13))
    whole[1:, 1:] = picture.cumsum(axis=0).cumsum(axis=1)
    n = frames - SPAN + 1

    def area(x: int, w: int, y: int, h: int) -> np.ndarray:
        """Sum over w frames from each start + x, and h classes from y."""
        return whole[x + w : x + w + n, y + h] - whole[x : x + n, y + h] - whole[x + w : x + w + n, y] + whole[x : x + n, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h in filters():
        if kind == 0:  # first half of the time against the second
            a, b = area(0, 8, y, h), area(8, 8, y, h)
        elif kind == 1:  # lower classes against higher ones
            a, b = area(0, 16, y, h // 2), area(0, 16, y + h // 2, h - h // 2)
        elif kind == 2:  # one diagonal against the other
            a = area(0, 8, y, h // 2) + area(8, 8, y + h // 2, h - h // 2)
            b = area(8, 8, y, h // 2) + area(0, 8, y + h // 2, h - h // 2)
        else:  # the middle of the time against its ends
            a, b = area(4, 8, y, h), area(0, 4, y, h) + area(12, 4, y, h)
        level = np.searchsorted(THRESHOLDS, np.log((1 + a) / (1 + b)))
        out = out << np.uint32(2) | _GRAY[level]
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """Offset of b's start in a, frames that agree on it, and the share of bits that differ in the overlap."""
    order = np.argsort(b, kind="stable")
    left, right = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    hits = np.concatenate([i - order[x:y] for i, (x, y) in enumerate(zip(left, right, strict=True)) if y > x] or [np.zeros(0, np.int64)])
    if not len(hits):
        return 0, 0, 1.0
    histogram = np.bincount(hits + len(b))
    offset = int(histogram.argmax()) - len(b)
    low, high = max(0, offset), min(len(a), offset + len(b))
    differ = np.bitwise_count(a[low:high] ^ b[low - offset : high - offset]).sum()
    return offset, int(histogram.max()), float(differ) / (32 * (high - low))


def linked(a: np.ndarray, b: np.ndarray, votes: int, errors: float, overlap: float) -> bool:
    offset, n, share = align(a, b)
    both = min(len(a), offset + len(b)) - max(0, offset)
    return n >= votes and share <= errors and both >= overlap * min(len(a), len(b))


def _printer(batches):
    classes: dict[int, np.ndarray] = {}
    for b in batches:
        for i in range(0, b.num_rows, 200):
            rows = b.slice(i, 200)
            prints, digests = [], []
            for audio, rate in zip(rows.column("audio").to_pylist(), rows.column("rate").to_pylist(), strict=True):
                if rate and rate not in classes:
                    classes[rate] = pitch_classes(rate)
                p = fingerprint(audio, rate, classes[rate]) if rate else np.zeros(0, np.uint32)
                prints.append(p.tobytes())
                digests.append(hashlib.blake2b(prints[-1], digest_size=16).digest())
            yield pa.record_batch([rows.column("media_id"), rows.column("row"), pa.array(prints, pa.binary()), pa.array(digests, pa.binary())], ["media_id", "row", "print", "digest"])


def tokens(p: np.ndarray) -> np.ndarray:
    """Of each integer the first, second and further occurrence, as one number: the integer, and how many equal ones come before."""
    order = np.argsort(p, kind="stable")
    ranked = p[order]
    first = np.searchsorted(ranked, ranked, "left")
    return (ranked.astype(np.uint64) << np.uint64(32) | (np.arange(len(p)) - first).astype(np.uint64)).view(np.int64)


def common_tokens(prints: list[np.ndarray]) -> np.ndarray:
    """How many tokens each recording of a block shares with each other one, in steps of tokens."""
    every = [tokens(p) for p in prints]
    kinds, at = np.unique(np.concatenate(every), return_inverse=True)
    times = np.bincount(at, minlength=len(kinds))
    held = times[at] > 1
    at, who = (np.cumsum(times > 1) - 1)[at[held]], np.repeat(np.arange(len(prints)), [len(t) for t in every])[held]
    out = np.zeros((len(prints), len(prints)), np.float32)
    for low in range(0, (last := int(at.max(initial=-1)) + 1), 4096):
        part = (at >= low) & (at < low + 4096)
        has = np.zeros((len(prints), min(4096, last - low)), np.float32)
        has[who[part], at[part] - low] = 1
        out += has @ has.T
    return out


def _tokens(batches):
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            rows = b.slice(i, 1000)
            found = [tokens(np.frombuffer(p, np.uint32)) for p in rows.column("print").to_pylist()]
            node = np.repeat(rows.column("node").to_numpy(), [len(t) for t in found])
            yield pa.record_batch([pa.array(node, pa.int64()), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], ["node", "key"])


def _checker(votes: int, errors: float, overlap: float):
    @F.pandas_udf("boolean")
    def check(a, b):
        import pandas as pd

        return pd.Series([linked(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), votes, errors, overlap) for x, y in zip(a, b, strict=True)], dtype=bool)

    return check


def _block_links(rows: list[tuple], votes: int, errors: float, overlap: float) -> list[tuple[int, int]]:
    """Of (side, node, comp, print) rows of one block against another (or itself): links between different components."""
    side, node, comp = (np.array([r[i] for r in rows]) for i in range(3))
    meet = (comp[:, None] != comp) & ((side[:, None] < side) | (side[:, None] == 2) & (side == 2) & (node[:, None] < node))
    if not meet.any():
        return []
    prints = [np.frombuffer(r[3], np.uint32) for r in rows]
    near = zip(*np.nonzero(meet & (common_tokens(prints) >= votes)), strict=True)
    return [(rows[i][1], rows[j][1]) for i, j in near if linked(prints[i], prints[j], votes, errors, overlap)]


def _blocks(votes: int, errors: float, overlap: float):
    def links(group: list[tuple]) -> pa.RecordBatch:
        found = _block_links(group, votes, errors, overlap)
        return pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    def go(batches):
        """Rows come sorted by block, which may go on in the next batch; one block is held at a time."""
        at, group = None, []
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                key, i, j, *rest = (part.column(c).to_pylist() for c in ("key", "i", "j", "side", "node", "comp", "print"))
                for block, row in zip(zip(key, i, j, strict=True), zip(*rest, strict=True), strict=True):
                    if block != at:
                        if len(group) > 1:
                            yield links(group)
                        at, group = block, []
                    group.append(row)
        if len(group) > 1:
            yield links(group)

    return go


def _labelled(lists: DataFrame, label: DataFrame) -> DataFrame:
    """key, node, comp of the keys that more than two recordings have: the two of another key have been compared by now."""
    some = lists.filter("n > 2").select("key", "node")
    return some.join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("comp"))


def components_of_prints(nodes: DataFrame, votes: int = 8, errors: float = 0.15, overlap: float = 0.5) -> DataFrame:
    """node, label of the nodes (node, print) that have links, each print being there once."""
    every = common.stored(nodes.mapInArrow(_tokens, "node long, key long"), "print-tokens")
    times = every.groupBy("key").agg(F.count("*").alias("n"))
    ranked = every.join(times, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.struct("n", "key")))).alias("ranked"))
    prefix = ranked.filter(F.size("ranked") >= votes).select("node", F.explode(F.slice("ranked", 1, F.size("ranked") - (votes - 1))).alias("at"))
    keys = common.stored(prefix.select("node", "at.key"), "print-prefixes")
    lead = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    lists = common.stored(keys.join(lead, "key"), "print-keys")
    check = _checker(votes, errors, overlap)
    only = nodes.select("node", "print")
    pairs = lists.filter("node <> lead").select("node", "lead").distinct().join(only, "node").withColumnRenamed("print", "x").join(only.withColumnsRenamed({"node": "lead", "print": "y"}), "lead")
    found = common.stored(pairs.filter(check("x", "y")).select(F.col("node").alias("a"), F.col("lead").alias("b")), "print-links")
    label = components(found)
    known = _labelled(lists, label)
    counts = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low < high")
    open_ = known.join(counts.select("key", F.ceil(F.col("n") / BLOCK).alias("chunks")), "key").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    met = open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = met.select("key", "node", "comp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1).alias("side"))
    blocks = met.join(only, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = blocks.select("key", "i", "j", "side", "node", "comp", "print").mapInArrow(_blocks(votes, errors, overlap), "a long, b long").distinct()
    return components(found.unionByName(common.stored(more, "print-links")))


def align_recordings(media: DataFrame, votes: int = 8, errors: float = 0.15, overlap: float = 0.5) -> DataFrame:
    """media_id, n_codes, print_sha256, component_id of every row: the smallest media_id that links lead to."""
    rows = common.columns(media, media_id="long", audio="binary", rate="int").withColumn("row", F.monotonically_increasing_id())
    prints = common.stored(rows.mapInArrow(_printer, "media_id long, row long, print binary, digest binary"), "prints")
    first = prints.filter("length(print) > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("media_id").alias("low"))
    nodes = prints.join(first.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "print")
    label = components_of_prints(nodes, votes, errors, overlap)
    classes = first.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = classes.join(classes.groupBy("label").agg(F.min("low").alias("component_id")), "label").select("digest", "component_id")
    out = prints.select("media_id", (F.length("print") / 4).cast("long").alias("n_codes"), F.sha2("print", 256).alias("print_sha256"), "digest").join(classes, "digest", "left")
    return out.select("media_id", "n_codes", "print_sha256", F.coalesce("component_id", "media_id").alias("component_id"))


def tones(vector: list | None, rate: int = 8192, note: int = 256) -> bytes | None:
    """A vector as sound: each component is a note whose pitch (of 24 semitones) follows its value."""
    if not vector or any(x is None or not np.isfinite(x) for x in vector):
        return None
    v = np.array(vector, np.float64)
    semitone = np.floor(12 + 12 * np.clip(v / max(1e-9, 2.5 * np.sqrt((v * v).mean())), -0.999, 0.999))
    turn = np.repeat(220 * 2 ** (semitone / 12), note).cumsum() / rate
    return (12000 * np.sin(2 * np.pi * turn)).astype("<i2").tobytes()


def render(vectors: DataFrame, rate: int = 8192) -> DataFrame:
    """media_id, audio, rate of vec_id and embedding: the tables here hold no recordings, so their vectors are played."""

    def go(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                rows = b.slice(i, 500)
                audio = [tones(v, rate) for v in rows.column("embedding").to_pylist()]
                yield pa.record_batch([rows.column("vec_id"), pa.array(audio, pa.binary()), pa.array([rate] * len(audio), pa.int32())], ["media_id", "audio", "rate"])

    return common.columns(vectors, vec_id="long", embedding="array<float>").mapInArrow(go, "media_id long, audio binary, rate int")
