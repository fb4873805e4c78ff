"""N-gram Jaccard join by a token-group matrix.

A document's set holds 64-bit hashes of its word shingles. Sets with a similarity of t share a token among their first
n - ceil(t n) + 1 tokens in any common order. The order here is by how many sets have a token: tokens of one set alone come
first and lead nowhere, so that a document with enough tokens of its own has no candidates, whatever passages it shares.

How many sets have a token is counted twice, by runs of packed tokens that are exchanged by token range and never become
rows: first for a fixed slice of the hash space, twice as large as a prefix, which settles most documents; then, for the
documents that are left, for all their tokens.

Sets are partitioned into groups of similar ones, by the smallest hashes of their shared tokens. A set is first compared
with the leaders of its groups, those with the fewest tokens of their own, which settles groups of copies in a few
comparisons a document. Where a token of a prefix still joins sets of different components, the token-group matrix tells
which groups of sets it leads to. A group stores the union of its sets' tokens, hashed to bits; what of the query's bits
is not in the union bounds its overlap with every set within, and only groups that the bound admits are sent the query's
tokens and opened. Every pair of sets that could link is in one component by then, or was compared.

Defined cases: null and empty texts, and those without words, have no shingles and are linked with nothing; repeated
rows and equal sets are one node's members; an empty table gives an empty result; columns besides doc_id and text are
ignored; a component's id is the smallest doc_id in it that is not null; texts of any length are taken in pieces.
"""

from __future__ import annotations

import struct
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graphs import components

#: Sets in a group, and tokens in a group, a run, or the queries that one task puts to a group: they bound memory alone.
GROUP = 128
TOKENS = 1 << 20
#: Ranges of tokens for each partition: a task takes them one after another.
RANGES = 4
KEYS = 3
_STEP = 1_000_000
_TABLE = bytes(32 if c in (9, 10, 11, 12, 13, 32) else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


# Sets.


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    kept = common.cache("shingles")
    if len(kept.get("powers", [()])[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        kept["powers"] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, _STEP), b, np.uint64)])) for b in (_BASE, inverse)]
    return kept["powers"]


def shingle_sets(texts: list[str | None], words: int = 4) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles (unsigned 64-bit)."""
    out: list[np.ndarray] = []
    part, size = [], 0
    for t in texts:
        data = (t or "").encode().translate(_TABLE)
        if len(data) > _STEP:
            out += _sets(part, words) if part else []
            part, size = [], 0
            out.append(_long(data, words))
            continue
        part.append(data)
        size += len(data) + 1
        if size > _STEP:
            out += _sets(part, words)
            part, size = [], 0
    return out + (_sets(part, words) if part else [])


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of words, and where they start."""
    data = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], data != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def _long(data: bytes, words: int) -> np.ndarray:
    """A long text's set: its words are hashed piece by piece."""
    found, start = [], 0
    while start < len(data):
        end = data.find(b" ", start + _STEP)
        end = len(data) if end < 0 else end
        found.append(_hashed(data[start:end])[0])
        start = end
    word = np.concatenate(found)
    return _each(word, np.array([0, len(word)]), words)[0]


def _sets(parts: list[bytes], words: int) -> list[np.ndarray]:
    word, start = _hashed(b" ".join([*parts, b""]))
    ends = np.cumsum([len(p) + 1 for p in parts])
    return _each(word, np.searchsorted(start, np.concatenate([[0], ends])), words)


def _each(word: np.ndarray, first: np.ndarray, words: int) -> list[np.ndarray]:
    """The sets of texts, of which each begins at one of `first`."""
    n = len(word)
    shingle = word.copy()
    for j in range(1, min(words, n)):
        shingle[: n - j] = _mix(shingle[: n - j] * _BASE + word[j:])
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(shingle[a : b - words + 1]))
        elif b > a:
            h = word[a : a + 1].copy()
            for j in range(a + 1, b):
                h = _mix(h * _BASE + word[j : j + 1])
            out.append(_mix(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _arrays(column) -> list[np.ndarray]:
    """The lists of a column of array<long>, as unsigned numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    return [values[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]


# Runs of tokens.

RUN = "part int, block long, doc_id array<long>, text_hash array<long>, row array<long>, n array<long>, sent array<long>, digest array<binary>, same array<int>, run binary"
_NAMES = [c.split()[0] for c in RUN.split(", ")]
_LISTS = [*[pa.list_(pa.int64())] * 5, pa.list_(pa.binary()), pa.list_(pa.int32())]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte by byte: the high bytes of small numbers cost nothing."""
    parts = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(arrays[0])) + b"".join(parts))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        cells = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(cells.T).reshape(-1).view(kind))
        at += size
    return out


def _runs(block: int, sets: list[np.ndarray], parts: int, top: int, drop: int):
    """(part, run) for a block's sets: its tokens below `top` by range, sorted, each with the place of its set."""
    tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    order = np.argsort(tokens)
    tokens, owner = tokens[order] >> np.uint64(drop), owner[order]
    edges = np.array([(top * i // parts) >> drop for i in range(1, parts)], np.uint64)
    cut = [0, *np.searchsorted(tokens, edges).tolist(), len(tokens)]
    for p in range(parts):
        if cut[p] < cut[p + 1]:
            own = tokens[cut[p] : cut[p + 1]]
            yield p, _pack(np.diff(own, prepend=np.uint64(0)), owner[cut[p] : cut[p + 1]])


class _Block:
    """Sets on their way to the ranges; rows with equal sets send them once."""

    def __init__(self, parts: int, top: int, drop: int):
        self.parts, self.top, self.drop, self.number = parts, top, drop, 0
        self.clear()

    def clear(self):
        self.info: list[tuple] = []
        self.sets: list[np.ndarray] = []
        self.places: dict[bytes, int] = {}
        self.size = 0

    def add(self, doc_id, text_hash, row, n, digest, tokens):
        place = self.places.setdefault(digest, len(self.sets))
        if place == len(self.sets):
            self.sets.append(tokens)
            self.size += len(tokens)
        self.info.append((doc_id, text_hash, row, n, len(tokens), digest, place))
        return self.size >= TOKENS or len(self.info) >= 60_000

    def close(self):
        if not self.info:
            return
        block = TaskContext.get().partitionId() << 32 | self.number
        none = [None] * len(_LISTS)
        rows = [(block % self.parts, block, *map(list, zip(*self.info, strict=True)), None)]
        rows += [(p, block, *none, run) for p, run in _runs(block, self.sets, self.parts, self.top, self.drop)]
        kinds = [pa.int32(), pa.int64(), *_LISTS, pa.binary()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)
        self.number += 1
        self.clear()


def _describe(words: int, parts: int, top: int):
    """Documents' sets; of their tokens those below `top` are sent, without the last 16 bits."""

    def run(batches):
        block = _Block(parts, top, 16)
        for rows in common.slices(batches, _STEP):
            sets = shingle_sets(rows.column("text").to_pylist(), words)
            names = zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text_hash", "row")), strict=True)
            for name, s in zip(names, sets, strict=True):
                low = s[: np.searchsorted(s, np.uint64(top))] if top < 1 << 64 else s
                if block.add(*name, len(s), blake2b(s.tobytes(), digest_size=16).digest(), low.copy()):
                    yield from block.close()
        yield from block.close()

    return run


def _send(parts: int):
    """Nodes' sets, all their tokens."""

    def run(batches):
        block = _Block(parts, 1 << 64, 0)
        for rows in common.slices(batches, TOKENS, lambda b: b.column("n").to_numpy()):
            for node, n, tokens in zip(rows.column("node").to_pylist(), rows.column("n").to_pylist(), _arrays(rows.column("tokens")), strict=True):
                if block.add(None, None, node, n, node.to_bytes(8, "big", signed=True), tokens.copy()):
                    yield from block.close()
        yield from block.close()

    return run


def _counter(named: bool):
    """Which tokens of a range several sets have: for each block how many of each set, or (`named`) the tokens themselves."""

    def settle(runs: list):
        found = [_unpack(r, "<u8", "<u2") for _, r in runs]
        tokens = np.concatenate([np.cumsum(t) for t, _ in found])
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(first) - 1
        many = np.empty(len(tokens), np.uint32)
        many[order] = np.bincount(group).astype(np.uint32)[group]
        end = 0
        for (block, _), (t, owner) in zip(runs, found, strict=True):
            start, end = end, end + len(t)
            at = start + np.flatnonzero(many[start:end] > 1)
            if not len(at):
                continue
            if named:
                yield block, _pack(owner[at - start], many[at], tokens[at])
            else:
                n = np.bincount(owner[at - start])
                which = np.flatnonzero(n)
                yield block, _pack(which.astype("<u2"), n[which].astype("<u4"))

    def run(batches):
        by: dict[int, list] = {}
        for b in batches:
            is_run = b.column("run").is_valid()
            info = b.filter(pc.invert(is_run))
            if info.num_rows:
                yield info
            runs = b.filter(is_run)
            for part, block, blob in zip(*(runs.column(c).to_pylist() for c in ("part", "block", "run")), strict=True):
                by.setdefault(part, []).append((block, blob))
        for part in sorted(by):
            done = list(settle(by.pop(part)))
            if done:
                n = len(done)
                columns = [pa.array([part] * n, pa.int32()), pa.array([x for x, _ in done], pa.int64()), *(pa.nulls(n, k) for k in _LISTS), pa.array([x for _, x in done], pa.binary())]
                yield pa.record_batch(columns, _NAMES)

    return run


def _head(table: pa.Table) -> tuple[dict, list[bytes]]:
    """A block's rows, and the answers for it."""
    is_run = table.column("run").is_valid()
    return table.filter(pc.invert(is_run)).to_pylist()[0], table.column("run").filter(is_run).to_pylist()


def _assess(table: pa.Table) -> pa.Table:
    """How many tokens of each row's slice no other set has."""
    info, answers = _head(table)
    shared = np.zeros(max(info["same"]) + 1, np.int64)
    for r in answers:
        which, n = _unpack(r, "<u2", "<u4")
        shared[which] += n
    alone = np.array(info["sent"]) - shared[info["same"]]
    kinds = {"doc_id": pa.int64(), "text_hash": pa.int64(), "row": pa.int64(), "n": pa.int64(), "digest": pa.binary()}
    return pa.table([*(pa.array(info[c], k) for c, k in kinds.items()), pa.array(alone)], [*kinds, "alone"])


def _bits(tokens: np.ndarray, n: int) -> bytes:
    """Tokens hashed to at least 8 n bits, a power of two; the higher half folds onto the lower one."""
    size = 64
    while size < 8 * n:
        size *= 2
    out = np.zeros(size, bool)
    out[(_mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


NODE = "node long, n long, many long, prefix array<long>, keys array<long>, bits binary, tokens array<long>"


def _rank(num: int, den: int):
    """Nodes that could link: their shared tokens, the part of their prefix that others have, group keys and bits."""

    def run(table: pa.Table) -> pa.Table:
        info, answers = _head(table)
        found = [_unpack(r, "<u2", "<u4", "<u8") for r in answers]
        owner, many, tokens = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.uint64)]) for i in range(3))
        order = np.lexsort((tokens, many, owner))
        owner, tokens = owner[order], tokens[order].astype(np.uint64)
        cut = np.searchsorted(owner, np.arange(len(info["row"]) + 1))
        out: list[list] = [[] for _ in range(7)]
        for i, (node, n) in enumerate(zip(info["row"], info["n"], strict=True)):
            own = tokens[cut[i] : cut[i + 1]]
            left = n + num * n // -den + 1 - (n - len(own))  # of the prefix, what is not the set's alone
            if left > 0 and len(own):
                keys = [_mix(own + np.uint64(k + 1)).min() for k in range(KEYS)]
                for column, v in zip(out, (node, n, len(own), own[:left], np.array(keys, np.uint64), _bits(own, n), np.sort(own)), strict=True):
                    column.append(v)
        longs = [pa.array(c, pa.int64()) for c in out[:3]]
        return pa.table([*longs, _lists(out[3]), _lists(out[4]), pa.array(out[5], pa.binary()), _lists(out[6])], ["node", "n", "many", "prefix", "keys", "bits", "tokens"])

    return run


def _full(words: int):
    """The sets of texts that were chosen by their hashes, where the text is the one that was meant."""

    def run(batches):
        for rows in common.slices(batches, _STEP):
            sets = shingle_sets(rows.column("text").to_pylist(), words)
            same = [j for j, (s, d) in enumerate(zip(sets, rows.column("digest").to_pylist(), strict=True)) if blake2b(s.tobytes(), digest_size=16).digest() == d]
            rows = rows.take(pa.array(same, pa.int64()))
            yield pa.record_batch([rows.column("node"), rows.column("n"), _lists([sets[j] for j in same])], ["node", "n", "tokens"])

    return run


# Groups.


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def _words(column) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def _standing(t: pa.Table) -> list[tuple[int, int]]:
    """Of two components the smaller one asks; equal ones by label."""
    return list(zip(t.column("members").to_pylist(), t.column("comp").to_pylist(), strict=True))


def _admit(num: int, den: int):
    """Queries against one group: the bound by the union first, then by each member; those that pass."""

    def run(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and held.num_rows:
            of, sizes, many, mine = _standing(held), held.column("n").to_numpy(), held.column("many").to_numpy(), _words(held.column("bits"))
            by = {w: np.flatnonzero([len(m) == w for m in mine]) for w in {len(m) for m in mine}}
            by = {w: (rows, np.stack([mine[r] for r in rows])) for w, rows in by.items()}
            union = {w: np.bitwise_or.reduce(bits, axis=0) for w, (_, bits) in by.items()}
            folded: dict[tuple[int, int], tuple] = {}
            queries = zip(asked.column("node").to_pylist(), _standing(asked), asked.column("n").to_pylist(), asked.column("many").to_pylist(), _words(asked.column("bits")), strict=True)
            for node, standing, n, m, bits in queries:
                for w, (rows, _) in by.items():
                    w2 = min(w, len(bits))
                    if (w, w2) not in folded:
                        folded[w, w2] = _fold(union[w], w2), _fold(by[w][1], w2)
                    whole, each = folded[w, w2]
                    q = _fold(bits, w2)
                    least = int(sizes[rows].min())
                    if (num + den) * (m - int(np.bitwise_count(q & ~whole).sum())) < num * (n + least):
                        continue
                    over = np.minimum(m - np.bitwise_count(q & ~each).sum(axis=1, dtype=np.int64), many[rows] - np.bitwise_count(~q & each).sum(axis=1, dtype=np.int64))
                    if any(of[rows[j]] > standing for j in np.flatnonzero((num + den) * over >= num * (n + sizes[rows])).tolist()):
                        found.append(node)
                        break
        return pa.table({"node": pa.array(found, pa.int64()), "group": pa.array(held.column("group").to_pylist()[:1] * len(found), pa.int64())})

    return run


def _opener(num: int, den: int):
    """Queries against the sets of a group that the bound admits: a link to each other component."""

    def run(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        a, b = [], []
        if asked.num_rows and held.num_rows:
            nodes, of, sizes, sets = held.column("node").to_pylist(), _standing(held), held.column("n").to_numpy(), _arrays(held.column("tokens"))
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            queries = zip(asked.column("node").to_pylist(), _standing(asked), asked.column("n").to_pylist(), _arrays(asked.column("tokens")), strict=True)
            for node, standing, n, tokens in queries:
                at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
                overlap = np.bincount(owner[tokens[at] == flat], minlength=len(sets))
                seen = set()
                for j in np.flatnonzero(den * overlap >= num * (n + sizes - overlap)).tolist():
                    if of[j] > standing and of[j] not in seen:
                        seen.add(of[j])
                        a.append(node)
                        b.append(nodes[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _census(rows: DataFrame, ask, named: bool, result, schema: str) -> DataFrame:
    """Tokens are sent to their ranges in runs, and what is found comes back to the blocks they came from."""
    parts = common.partitions(rows.sparkSession)
    runs = rows.mapInArrow(ask, RUN).repartitionById(parts, F.expr(f"part % {parts}"))
    return runs.mapInArrow(_counter(named), RUN).groupBy("block").applyInArrow(result, schema)


def describe(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """A stored row for each of docs: doc_id, text_hash, row, n, digest; alone: how many tokens of its slice no other has."""
    rows = common.columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("text_hash"), "text")
    top = min(1 << 64, (1 << 64) * 2 * (den - num) // den)
    ask = _describe(words, RANGES * common.partitions(docs.sparkSession), top)
    return common.stored(_census(rows, ask, False, _assess, "doc_id long, text_hash long, row long, n long, digest binary, alone long"), "shingles")


def candidates(sets: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The stored nodes that could link."""
    few = F.expr(f"n > 0 AND alone < n - (n * {num} + {den - 1}) div {den} + 1")
    chosen = sets.filter(few).groupBy("digest").agg(F.min(F.struct("row", "doc_id", "text_hash", "n")).alias("x"))
    chosen = chosen.select(F.col("x.row").alias("node"), F.col("x.doc_id").alias("id"), F.col("x.text_hash").alias("hash"), F.col("x.n").alias("n"), "digest")
    texts = common.columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    # By hash and id: rows that share an id, or have none, would each be joined to all the others.
    full = texts.join(chosen, (chosen["hash"] == texts["text_hash"]) & chosen["id"].eqNullSafe(texts["doc_id"])).select("node", "n", "digest", "text")
    full = full.mapInArrow(_full(words), "node long, n long, tokens array<long>")
    names = sets.filter(few).groupBy("digest", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    if not names.filter("rows > 1").isEmpty():  # equal rows, each of which was joined to the one that stands for them
        full = full.dropDuplicates(["node"])
    full = common.stored(full, "shingle-sets")
    ask = _send(RANGES * common.partitions(docs.sparkSession))
    return common.stored(_census(full, ask, True, _rank(num, den), NODE), "shingle-nodes")


def links(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that join every component of similar nodes."""
    both = num + den
    small = nodes.select("node", "n", "many")
    # Each node with the leaders of its groups.
    keyed = nodes.select("node", "n", "many", F.posexplode("keys").alias("turn", "key"))
    own = (1 - F.col("many") / F.col("n")).alias("own")
    leads = keyed.groupBy("turn", "key").agg(F.min(F.struct(own, "node", "n", "many")).alias("lead"), F.count("*").alias("held")).filter("held > 1")
    pairs = keyed.join(leads, ["turn", "key"]).select("node", "n", "many", F.col("lead.node").alias("lead"), F.col("lead.n").alias("n2"), F.col("lead.many").alias("many2"))
    pairs = pairs.filter((F.col("node") != F.col("lead")) & (F.least("many", "many2") * both >= (F.col("n") + F.col("n2")) * num)).select("node", "lead").distinct()
    left, right = nodes.select("node", "n", "tokens").alias("x"), nodes.select("node", "n", "tokens").alias("y")
    sides = pairs.join(left, "node").select("node", "lead", F.col("n").alias("na"), F.col("tokens").alias("ta"))
    sides = sides.join(right, sides["lead"] == F.col("y.node")).select(sides["node"].alias("a"), F.col("lead").alias("b"), "na", F.col("y.n").alias("nb"), F.size(F.array_intersect("ta", F.col("y.tokens"))).alias("o"))
    found = common.stored(sides.filter((F.col("o") * both >= (F.col("na") + F.col("nb")) * num)).select("a", "b"), "shingle-links")
    # What tokens still join different components. A component that fills a group has groups of its own.
    label = components(found)
    known = small.join(label, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    known = known.join(known.groupBy("comp").agg(F.count("*").alias("members")), "comp")
    cell = F.when(F.col("members") >= GROUP, F.xxhash64("comp")).otherwise(F.xxhash64("key", F.lit(1)))
    known = known.join(keyed.filter("turn = 0").select("node", "key"), "node").withColumn("cell", cell)
    chunks = known.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("many") / TOKENS)).alias("chunks"))
    group = F.xxhash64("cell", F.pmod(F.xxhash64("node"), F.col("chunks"))).alias("group")
    known = common.stored(known.join(chunks, "cell").select("node", "n", "many", "comp", "members", group), "shingle-known")
    # Of what stands before a token in the prefix, nothing is shared with whom it is the first token in common.
    lists = nodes.select("node", "many", F.posexplode("prefix").alias("at", "token"))
    lists = lists.select("node", (F.col("many") - F.col("at")).alias("reach"), "token").join(known, "node")
    mixed = lists.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token")
    open_ = common.stored(lists.join(mixed, "token", "left_semi"), "shingle-open")
    # The matrix: for each token the groups it leads to, in lists of about 256, with what bounds an overlap there. A query
    # asks about larger components, so that of two sets one asks.
    standing = F.struct("members", "comp")
    cells = open_.groupBy("token", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach"), F.max(standing).alias("top"))
    cells = cells.join(cells.groupBy("token").agg(F.ceil(F.count("*") / 256).alias("parts")), "token")
    cells = cells.groupBy("token", F.pmod(F.col("group"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("group", "least", "most", "reach", "top")).alias("groups"))
    n, least = F.col("n"), lambda g: F.greatest(g["least"], F.ceil(F.col("n") * num / den))
    worth = lambda g: (g["top"] > standing) & (g["least"] * num <= n * den) & (n * num <= g["most"] * den) & (F.least(F.col("reach"), g["reach"]) * both >= (n + least(g)) * num)
    met = open_.join(cells, "token").select("node", F.transform(F.filter("groups", worth), lambda g: g["group"]).alias("groups")).filter("size(groups) > 0")
    met = met.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("groups"))).alias("groups"))
    met = common.stored(met.select("node", F.explode("groups").alias("group")), "shingle-met")
    if met.isEmpty():
        return found
    bits = nodes.select("node", "bits").join(known, "node")
    admitted = common.stored(_asked(met, bits, "bits", "many").applyInArrow(_admit(num, den), "node long, group long"), "shingle-admitted")
    tokens = nodes.select("node", "tokens").join(known, "node")
    more = _asked(admitted, tokens, "tokens", "many").applyInArrow(_opener(num, den), "a long, b long")
    return found.unionByName(common.stored(more, "shingle-links"))


def _asked(met: DataFrame, sets: DataFrame, column: str, size: str):
    """Queries and the groups they ask, together; of a group that very many ask there are several copies."""
    columns = ["node", "n", "many", "comp", "members", column]
    sizes = met.join(sets.select("node", size), "node").groupBy("group").agg(F.ceil(F.sum(size) / (4 * TOKENS)).alias("salts"))
    query = met.join(sizes, "group").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts"))).join(sets.select(*columns), "node")
    held = sizes.select(F.col("group").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("copy"))
    held = sets.select("group", *columns).join(held, F.col("group") == F.col("own"))
    query, held = (df.select(F.xxhash64("group", s).alias("at"), *(F.col(c).alias(c) for c in ("group", *columns))) for df, s in ((query, "salt"), (held, "copy")))
    return query.groupBy("at").cogroup(held.groupBy("at"))


def _components(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """A row for each of docs (doc_id, text_hash, n, digest), and digest, label of every set that isn't empty."""
    sets = describe(docs, words, num, den)
    label = components(links(candidates(sets, docs, words, num, den), num, den))
    first = sets.filter("n > 0").groupBy("digest").agg(F.min("row").alias("least"), F.min("doc_id").alias("low"))
    # A node is the least row of its digest.
    return sets, first.join(label, first["least"] == label["node"], "left").select("digest", "low", F.coalesce("label", "least").alias("label"))


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link when den x intersection >= num x union."""
    sets, classes = _components(docs, words, num, den)
    ids = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    classes = classes.join(ids, "label").select("digest", "component_id")
    small = sets.select("doc_id", "row", F.col("n").alias("n_shingles"), "digest")
    out = small.filter("n_shingles > 0").join(classes, "digest").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(small.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row of each component, and all rows without words. Ids may be null or occur more than once.

    The row is the one with the smallest id that is not null, by the hash of its text where the id has several texts. Of
    rows that agree in id and text the smallest by its other columns stays.
    """
    sets, classes = _components(docs, words, num, den)
    names = sets.filter("n > 0").join(classes.select("digest", "label"), "digest").groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "copies")).alias("one")
    first = names.groupBy("label").agg(first).select(F.col("one.doc_id").alias("_doc_id"), F.col("one.text_hash").alias("_text_hash"), F.col("one.copies").alias("_copies"))
    first = common.stored(first, "shingle-first")
    has_words = F.coalesce(F.col("text").rlike(common.WORD), F.lit(False))
    named = docs.filter(has_words).join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("_text_hash")))
    kept = named.filter("_copies = 1").select(docs.columns)
    if not first.filter("_copies > 1").isEmpty():
        again = named.filter("_copies > 1").groupBy("_doc_id", "_text_hash").agg(F.min(F.struct(*docs.columns)).alias("_row"))
        kept = kept.unionByName(again.select("_row.*"))
    return kept.unionByName(docs.filter(~has_words))
