"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Every string of `length` bytes that occurs twice has, at the same place within both, the same anchor: the start of the
string of `length` / 2 bytes with the smallest hash among those that it holds. So the suffix array is a sparse one: only
suffixes that start at anchors whose string occurs twice are sorted, about one in `length` / 4 bytes of repeated text.
A suffix is taken as far as `length` bytes, and goes with the bytes before it.

Each task sorts its suffixes into runs; a run is cut at fixed splitters and exchanged front-coded: of each suffix, the
number of bytes it shares with the one before, and the rest. (Sort keys begin with the hash of the anchor's string, so
that equal ranges of hashes are even splitters, without a sample.) A loser tree merges the runs of a range; its nodes keep
the common prefixes of the losers, and no byte that is known to be equal is compared again. The merged order brings the
common prefixes of neighbours with it. Within suffixes that share the anchor's string, those prefixes and the common
endings of the bytes before tell which windows around an anchor recur.

Texts are named by two 64-bit hashes, and each distinct text is sorted once: one that has copies recurs as a whole.
Suffixes with the same bytes on both sides are one, first within a task, then within a range. An anchor's string that
occurs more than `hot` times could still gather in one task with different bytes around it: its windows are counted one
by one instead, by two 64-bit hashes of the whole window.

Defined cases: a null text is the empty one; a text shorter than `length` keeps everything; repeated rows repeat each
other, as do repeated passages within one document; matches never cross documents; an empty table gives an empty result;
columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN = 20_000
SEGMENT = 1 << 18
CHUNK = 8192
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SPAN = "h2 long, h long, first long, last long"


# Anchors.


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(data: np.ndarray, size: int, base: int = 0) -> np.ndarray:
    """A hash of each string of `size` bytes in `data`, by its start."""
    n = len(data)
    powers = common.cache("suffixes")
    if base not in powers or len(powers[base][0]) < n:
        b = _BASES[base]
        both = (b, pow(b, -1, 1 << 64))
        powers[base] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, SEGMENT + 4096), x, np.uint64)])) for x in both)
    power, inverse = powers[base]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return _mix((total[size:] - total[: n + 1 - size]) * inverse[: n + 1 - size])


def _segments(parts: list[bytes], length: int):
    """(document, offset, bytes): documents cut so that every window lies whole in exactly one segment."""
    for d, data in enumerate(parts):
        for at in range(0, max(1, len(data) - length + 1), SEGMENT):
            piece = data[at : at + SEGMENT + length - 1]
            if len(piece) >= length:
                yield d, at, piece


def anchors(parts: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document, the places of its anchors and the hashes of their strings."""
    out: list[list] = [[] for _ in parts]
    group, size = [], 0
    for seg in _segments(parts, length):
        group.append(seg)
        size += len(seg[2])
        if size >= SEGMENT:
            _anchor_group(group, length, out)
            group, size = [], 0
    if group:
        _anchor_group(group, length, out)
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    done = []
    for found in out:
        if found:
            at, h = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            at, first = np.unique(at, return_index=True)
            done.append((at, h[first]))
        else:
            done.append(none)
    return done


def _anchor_group(group: list, length: int, out: list[list]) -> None:
    data = np.frombuffer(b"".join(s[2] for s in group), np.uint8)
    core = length // 2
    w = length - core + 1
    h = _hashes(data, core)
    mask = np.uint64((1 << 22) - 1)
    n = len(h)
    rows = -(-n // w)
    ranked = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    ranked[:n] = (h & ~mask) | np.arange(n, dtype=np.uint64)
    ranked = ranked.reshape(rows, w)
    ahead = np.minimum.accumulate(ranked, axis=1).ravel()
    back = np.minimum.accumulate(ranked[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - w + 1], ahead[w - 1 : n])
    ends = np.cumsum([len(s[2]) for s in group])
    fine = np.ones(len(least), bool)
    for e in ends[:-1].tolist():
        fine[e - length + 1 : e] = False
    at = np.unique((least[fine] & mask).astype(np.int64))
    which = np.searchsorted(ends, at, "right")
    cut = np.searchsorted(which, np.arange(len(group) + 1))
    for k, (d, offset, piece) in enumerate(group):
        own = at[cut[k] : cut[k + 1]]
        # Anchors have small hashes; hashed once more, they spread evenly over the ranges of the merge.
        out[d].append((own - int(ends[k]) + len(piece) + offset, _mix(h[own] ^ np.uint64(_BASES[1]))))


def _finder(length: int):
    def find(batches):
        for rows in common.slices(batches, 2_000_000):
            data = [t.encode() for t in rows.column("text").to_pylist()]
            found = anchors(data, length)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(a) for a, _ in found])]).astype(np.int32))
            grams = pa.array(np.concatenate([*(g for _, g in found), np.zeros(0, np.uint64)]).view(np.int64))
            places = pa.array(np.concatenate([*(a for a, _ in found), np.zeros(0, np.int64)]).astype(np.int64))
            columns = [*(rows.column(c) for c in ("id", "h", "h2")), pa.array([len(d) for d in data], pa.int64()), pa.ListArray.from_arrays(ends, grams), pa.ListArray.from_arrays(ends, places)]
            yield pa.record_batch(columns, ["id", "h", "h2", "size", "grams", "places"])

    return find


# Runs.


def _common_prefix(a: bytes, b: bytes, i: int) -> int:
    """How many bytes two strings share, of which the first i are known to be equal."""
    n = min(len(a), len(b))
    while i < n:
        x, y = a[i : i + 64], b[i : i + 64]
        if x != y:
            m = min(len(x), len(y))
            z = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return i + m - (z.bit_length() + 7) // 8
        i += 64
    return n


def encode_run(keys: list[bytes], lefts: list[bytes], members: list[list[tuple[int, int, int]]]) -> bytes:
    """A sorted run, front-coded and compressed."""
    shared, rest, before = [], [], b""
    for k in keys:
        c = _common_prefix(before, k, 0)
        shared.append(c)
        rest.append(k[c:])
        before = k
    flat = np.array(list(chain.from_iterable(members)), np.int64).reshape(-1, 3)
    parts = [
        np.array(shared, "<u2").tobytes(), np.array([len(r) for r in rest], "<u2").tobytes(), np.array([len(x) for x in lefts], "<u2").tobytes(),
        np.array([len(m) for m in members], "<u4").tobytes(), flat.T.astype("<i8").tobytes(), b"".join(rest), b"".join(lefts),
    ]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<II", len(keys), len(flat)) + b"".join(parts))


def decode_run(blob: bytes) -> tuple[list[bytes], list[int], list[bytes], np.ndarray, np.ndarray]:
    """Keys, their common prefixes with the key before, lefts, numbers of members, members."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = struct.unpack_from("<II", raw)
    at = 8
    shared, rest, left = (np.frombuffer(raw, "<u2", n, at + 2 * n * i).tolist() for i in range(3))
    at += 6 * n
    counts = np.frombuffer(raw, "<u4", n, at).astype(np.int64)
    at += 4 * n
    members = np.frombuffer(raw, "<i8", 3 * m, at).reshape(3, m)
    at += 24 * m
    keys, before = [], b""
    for c, k in zip(shared, rest, strict=True):
        before = before[:c] + raw[at : at + k]
        keys.append(before)
        at += k
    lefts = []
    for k in left:
        lefts.append(raw[at : at + k])
        at += k
    return keys, shared, lefts, counts, members


def _runner(length: int, ranges: int):
    core = length - length // 2

    def close(found: dict):
        order = sorted(found)
        at = [int.from_bytes(k[0][:8], "big") * ranges >> 64 for k in order]
        cut = np.searchsorted(at, np.arange(ranges + 1)).tolist()
        for part in range(ranges):
            own = order[cut[part] : cut[part + 1]]
            if own:
                yield part, encode_run([k for k, _ in own], [x for _, x in own], [found[k] for k in own])

    def run(batches):
        found: dict[tuple[bytes, bytes], list] = {}
        seen: set[tuple[int, int]] = set()  # rows that repeat an id and its text come to the same task
        for i, h, text, places, grams in _rows(batches, "h2", "h", "text", "places", "grams"):
            if (i, h) in seen:
                continue
            seen.add((i, h))
            data = text.encode()
            for p, g in zip(places, grams, strict=True):
                key = ((g & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big") + data[p : p + length], data[max(0, p - core) : p])
                found.setdefault(key, []).append((i, h, p))
            if len(found) >= RUN:
                yield from _blobs(close(found))
                found = {}
        yield from _blobs(close(found))
        common.give_back()

    return run


def _rows(batches, *names: str, size: int = 500):
    """The rows of batches as Python values, a few at a time."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            part = b.slice(i, size)
            yield from zip(*(part.column(c).to_pylist() for c in names), strict=True)


def _blobs(items):
    for part, blob in items:
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["part", "run"])


# Merge.


def merge(runs: list[tuple[list[bytes], list[int]]]):
    """(run, index, common prefix with the one before) in sorted order, by a loser tree that keeps common prefixes.

    A leaf's string comes with the prefix that it shares with the last winner: its run's front coding. A loser keeps the
    prefix that it shares with whoever beat it, which is the last winner, wherever a new string passes. The longer prefix
    wins; only equal ones are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[] for _ in range(k - len(runs))]
    shared = [r[1] for r in runs] + [[] for _ in range(k - len(runs))]
    at = [0] * k
    loser, prefix = [-1] * k, [-1] * k

    def play(a: int, pa_: int, b: int, pb: int):
        """Winner, its prefix, loser, its prefix; -1 for a run that has ended."""
        if pa_ != pb:
            return (a, pa_, b, pb) if pa_ > pb else (b, pb, a, pa_)
        if pa_ < 0:
            return a, -1, b, -1
        x, y = strings[a][at[a]], strings[b][at[b]]
        c = _common_prefix(x, y, pa_)
        if x[c : c + 1] <= y[c : c + 1]:
            return a, pa_, b, c
        return b, pb, a, c

    def build(node: int):
        if node >= k:
            r = node - k
            return r, 0 if strings[r] else -1
        a, x = build(2 * node)
        b, y = build(2 * node + 1)
        w, p, loser[node], prefix[node] = play(a, x, b, y)
        return w, p

    w, p = build(1)
    while p >= 0:
        i = at[w]
        yield w, i, p
        i += 1
        at[w] = i
        p = shared[w][i] if i < len(strings[w]) else -1
        node = (w + k) >> 1
        while node:
            q = prefix[node]
            if q > p:
                loser[node], w = w, loser[node]
                prefix[node], p = p, q
            elif q == p >= 0:
                w, p, loser[node], prefix[node] = play(w, p, loser[node], q)
            node >>= 1


def _endings(lefts: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each item by (group, bytes before, read backwards), and what each shares with the one before in that order."""
    n = len(lefts)
    f = 2 if any(0 in x for x in lefts) else 1  # a zero byte must not look like the start of a document
    cells = np.zeros((n, -(-width * f // 8) * 8), np.uint8)
    sizes = np.array([len(x) for x in lefts])
    flat = np.frombuffer(b"".join(x[::-1] for x in lefts), np.uint8)
    row = np.repeat(np.arange(n), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if f == 2:
        cells[row, 2 * column] = 1
        cells[row, 2 * column + 1] = flat
    else:
        cells[row, column] = flat
    words = cells.view(">u8")
    order = np.lexsort([*words.T[::-1].astype(np.uint64), group])
    cells, sizes = cells[order], sizes[order]
    differ = cells[1:] != cells[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), cells.shape[1]) // f
    same = np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))
    same[group[order][1:] != group[order][:-1]] = -1
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank, np.concatenate([[-1], same])


def windows(rights: np.ndarray, shared: np.ndarray, lefts: list[bytes], many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes, the least and the largest distance before the anchor at which a recurring window starts.

    `rights`: bytes from the anchor on; `shared`: those in common with the suffix before (less than the anchor's string:
    another group); `many`: occurrences. A window that starts s before the anchor recurs if another suffix shares s bytes
    before it and length - s from it on. Where none does, the least is above the largest.
    """
    n, core = len(rights), length // 2
    room = length - core
    group = np.cumsum(shared < core)
    rank, ending = _endings(lefts, group, room)
    low = np.maximum(0, length - rights)
    high = np.minimum(room, np.array([len(x) for x in lefts]))
    least, most = np.full(n, length), np.full(n, -1)
    for s in range(room + 1):
        rows = np.flatnonzero((low <= s) & (s <= high))
        if not len(rows):
            continue
        key = np.cumsum(shared < length - s)[rows] * (n + 1) + np.cumsum(ending < s)[rank[rows]]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        twice = np.add.reduceat(many[rows][order], first) > 1
        found = rows[order[np.repeat(twice, np.diff(np.concatenate([first, [len(key)]])))]]
        most[found] = s
        least[found] = np.minimum(least[found], s)
    return least, most


def _merger(length: int):
    core = length // 2

    def resolve(items: list, members: list):
        """items: (key, common prefix, left, members); the spans of the members."""
        rights = np.array([len(x[0]) - 8 for x in items])
        shared = np.array([x[1] - 8 for x in items])
        shared[0] = -8
        group = np.cumsum(shared < core)
        many = np.array([sum(m.shape[1] for m in x[3]) for x in items])
        alone = np.bincount(group)[group] == 1
        least, most = np.full(len(items), length), np.full(len(items), -1)
        left = np.array([len(x[2]) for x in items])
        sole = alone & (many > 1)  # one text around the anchor, met more than once
        least[sole], most[sole] = np.maximum(0, length - rights[sole]), np.minimum(length - core, left[sole])
        rest = np.flatnonzero(~alone)
        if len(rest):
            least[rest], most[rest] = windows(rights[rest], shared[rest], [items[i][2] for i in rest], many[rest], length)
        good = np.flatnonzero(least <= most)
        if not len(good):
            return None
        own = [np.concatenate(items[i][3], axis=1) for i in good]
        n = [m.shape[1] for m in own]
        ids, h, place = np.concatenate(own, axis=1)
        return pa.record_batch([pa.array(ids), pa.array(h), pa.array(place - np.repeat(most[good], n)), pa.array(place - np.repeat(least[good], n) + length)], ["h2", "h", "first", "last"])

    def run(batches):
        common.cache("suffixes")
        by: dict[int, list] = {}
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("run").to_pylist(), strict=True):
                by.setdefault(part, []).append(blob)
        for part in sorted(by):
            runs = [decode_run(x) for x in by.pop(part)]
            ends = [np.concatenate([[0], np.cumsum(r[3])]) for r in runs]
            items: list = []
            sames: dict[bytes, int] = {}
            shortest = 1 << 30  # common prefix with the last item kept
            for r, i, p in merge([(x[0], x[1]) for x in runs]):
                key, left = runs[r][0][i], runs[r][2][i]
                own = runs[r][4][:, ends[r][i] : ends[r][i + 1]]
                if items and p == len(key) == len(items[-1][0]):
                    if left in sames:
                        items[sames[left]][3].append(own)
                        continue
                else:
                    sames = {}
                    if p < 8 + core and len(items) >= CHUNK:
                        if (out := resolve(items, [])) is not None:
                            yield out
                        items = []
                sames[left] = len(items)
                items.append((key, p, left, [own]))
            if items and (out := resolve(items, [])) is not None:
                yield out
            del runs, items, sames
            common.give_back()

    return run


# Anchors whose strings are very common: window by window.


def _windows(length: int):
    core = length // 2

    def run(batches):
        for i, h, text, places in _rows(batches, "h2", "h", "text", "hot"):
            data = text.encode()
            n = len(data) - length + 1
            starts = np.unique(np.concatenate([np.arange(max(0, p - (length - core)), min(p + 1, n)) for p in places]))
            # Pieces whose starts lie close together: the bytes between far ones need no hash.
            for near in np.split(starts, np.flatnonzero(np.diff(starts) > length) + 1):
                for k in range(0, len(near), 10_000):
                    at = near[k : k + 10_000]
                    lo = int(at[0])
                    part = np.frombuffer(data[lo : int(at[-1]) + length], np.uint8)
                    a, c = (_hashes(part, length, base)[at - lo].view(np.int64) for base in (0, 1))
                    yield pa.record_batch([pa.array(a), pa.array(c), pa.array(np.full(len(at), i)), pa.array(np.full(len(at), h)), pa.array(at)], ["a", "c", "h2", "h", "first"])

    return run


# The operator.


def _hashes_of(text) -> tuple:
    """Two independent hashes of a text, null being the empty one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("h2")


def repeated_spans(docs: DataFrame, length: int = 400, hot: int = 1 << 16) -> DataFrame:
    """h, h2, spans of the texts in which something recurs: byte ranges, which may overlap. A stored table."""
    spark = docs.sparkSession
    rows = common.columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), *_hashes_of(F.col("text")), "text")
    found = rows.mapInArrow(_finder(length), "id long, h long, h2 long, size long, grams array<long>, places array<long>").filter("size(grams) > 0")
    # One row of each text, and how often it is there.
    one = F.min_by(F.struct("size", "grams", "places"), "id").alias("one")
    texts = found.groupBy("h", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), one).select("id", "h", "h2", "copies", "one.*")
    texts = common.stored(texts, "anchors")
    each = texts.select("id", "h", "h2", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("id", "h", "h2", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    twice = common.stored(each.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-grams")
    kept = each.join(twice, "gram").groupBy("id", "h", "h2").agg(F.collect_list(F.when(F.col("n") <= hot, F.struct("place", "gram"))).alias("x"), F.collect_list(F.when(F.col("n") > hot, F.col("place"))).alias("hot"))
    kept = common.stored(kept.select("id", "h", "h2", F.transform("x", lambda x: x["place"]).alias("places"), F.transform("x", lambda x: x["gram"]).alias("grams"), "hot"), "repeated-anchors")
    wanted = rows.join(kept.hint("shuffle_hash"), ["id", "h", "h2"])
    ranges = common.partitions(spark)
    runs = wanted.mapInArrow(_runner(length, ranges), "part int, run binary")
    spans = runs.repartition(ranges, "part").mapInArrow(_merger(length), SPAN)
    if not kept.filter("size(hot) > 0").isEmpty():
        few = wanted.filter("size(hot) > 0").dropDuplicates(["id", "h", "h2"]).mapInArrow(_windows(length), "a long, c long, h2 long, h long, first long")
        more = few.join(few.groupBy("a", "c").agg(F.count("*").alias("n")).filter("n > 1"), ["a", "c"])
        spans = spans.unionByName(more.select("h2", "h", "first", (F.col("first") + length).alias("last")))
    whole = texts.filter("copies > 1").select("h2", "h", F.lit(0).cast("long").alias("first"), F.col("size").alias("last"))
    spans = spans.unionByName(whole).groupBy("h", "h2").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return common.stored(spans, "repeated-spans")


def _joined(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((s["first"], s["last"]) for s in ([] if spans is None else spans)):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *chain.from_iterable(spans), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


def _left(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The remaining text; a character cut in two goes as a whole."""
    return _kept(data, spans).decode("utf-8", "ignore")


def _report(batches):
    for rows in common.slices(batches, 4_000_000):
        out: tuple = ([], [], [], [], [])
        for text, spans in zip(rows.column("text").to_pylist(), rows.column("spans").to_pylist(), strict=True):
            data, spans = (text or "").encode(), _joined(spans)
            kept = hashlib.sha256(_kept(data, spans)).hexdigest()
            for column, v in zip(out, (len(data), sum(e - s for s, e in spans), len(spans), kept, _left(data, spans) if spans else text), strict=True):
                column.append(v)
        columns = [rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))]
        yield pa.record_batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def dedup(docs: DataFrame, length: int = 400, hot: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining text of every row."""
    rows = common.columns(docs, doc_id="long", text="string")
    rows = rows.select("doc_id", "text", *_hashes_of(F.col("text"))).join(repeated_spans(docs, length, hot), ["h", "h2"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def strip_repeats(docs: DataFrame, length: int = 400, hot: int = 1 << 16) -> DataFrame:
    """The rows with repeated bytes removed from their texts; a character cut in two goes as a whole.

    Rows that nothing was removed from, and null texts, stay as they were; a text of which nothing is left goes.
    """

    @F.pandas_udf("string")
    def strip(text, spans):
        import pandas as pd

        return pd.Series([_left(t.encode(), _joined(s)) for t, s in zip(text, spans, strict=True)], dtype=object)

    # The whole row in one column, so that no name can clash.
    rows = common.packed(docs).select("row", *_hashes_of(F.col("row.text"))).join(repeated_spans(docs, length, hot), ["h", "h2"], "left")
    cut = rows.filter("spans IS NOT NULL").withColumn("left", strip("row.text", "spans")).filter("left <> ''")
    row = F.col("row").withField("text", F.col("left"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("left").cast(docs.schema["n_chars"].dataType))
    same = rows.filter("spans IS NULL").select("row")
    return same.unionByName(cut.select(row.alias("row"))).select("row.*")
