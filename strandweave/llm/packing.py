"""Best-fit packing of documents into sequences, by bin completion.

The driver sees one number for each piece length (at most `capacity` of them, however large the input), and plans how
often each filling is used. Bin completion takes the largest length left, enumerates undominated fillings of the rest of
its sequence, and branches on them; a branch ends when its waste is above what the incumbent allows. Best-fit decreasing
gives the first incumbent. The search ends at the lower bound or after `steps` fillings: then the plan need not be the best. Pieces of one length are ranked in two levels, by salt, so that a length that most pieces have
is spread over many tasks, and each finds its sequence by its rank.

Defined cases: a null text is the empty one and has the end id alone; repeated rows are documents of their own; an empty
table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Choices at each place of the searches before the whole one.
WIDTHS = (1, 2, 3, 6)
OPEN = 64
PIECE = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (filling, times)."""
    open_: dict[int, Counter] = defaultdict(Counter)  # by room: filling, how many
    done: Counter = Counter()
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r, c in open_.items() if r >= size and c), default=None)
            if room is None:
                per = capacity // size  # an own sequence takes as many of one length as fit
                for k, times in ((per, left // per), (left % per, 1)):
                    if k and times:
                        open_[capacity - k * size][(size,) * k] += times
                break
            filling, times = next(iter(open_[room].items()))
            use = min(times, left)
            open_[room][filling] -= use
            open_[room] += Counter()
            open_[room - size][(*filling, size)] += use
            left -= use
    for c in open_.values():
        done.update(c)
    return [(f, n) for f, n in done.items() if n]


def _sums(bits: int, size: int, times: int, full: int) -> int:
    """The sums in `bits`, and each with up to `times` pieces of `size` more."""
    step = 1
    while times > 0:
        k = min(step, times)
        bits |= bits << k * size & full
        times, step = times - k, 2 * step
    return bits


def dominated(filling: tuple[int, ...], left: list[int], waste: int) -> bool:
    """Whether a filling gives way to another, whose pieces can be cut into its own (Martello and Toth).

    If so, some single exchange does it: a piece that is left over comes in, for a smaller one, for several, or for waste.
    """
    one, more = 1, 0  # sums of at most one piece, and of several
    for s in filling:
        more |= more << s | (one & ~1) << s
        one |= 1 << s
    full = (1 << len(left)) - 1
    swaps = _sums(more, 1, waste, full) | (_sums(one << 1, 1, waste - 1, full) if waste else 0)
    used = Counter(filling)
    return any(n > used[s] for s, n in enumerate(left) if n and swaps >> s & 1)


def fillings(have: np.ndarray, capacity: int) -> Iterator[tuple[int, ...] | None]:
    """Fillings of one sequence around the largest length in `have` (counts by length) that no other one dominates.

    They are made one at a time, for there may be very many: least waste first, and of equal waste larger pieces first. A
    None stands for a filling that was found to be dominated, so that whoever asks can count it.
    """
    largest = int(np.flatnonzero(have)[-1])
    room = capacity - largest
    left = have[: room + 1].tolist()
    if largest <= room:
        left[largest] -= 1
    sizes, full = [s for s, n in enumerate(left) if n], (1 << room + 1) - 1
    reach = [1]  # reach[i] has the sums of the i smallest lengths as bits
    for s in sizes:
        if reach[-1] == full:
            reach += [full] * (len(sizes) + 1 - len(reach))
            break
        reach.append(_sums(reach[-1], s, min(left[s], room // s), full))

    def exact(i: int, rest: int) -> Iterator[tuple[int, ...]]:
        """Each multiset of the i smallest lengths that adds up to `rest`; none is looked at in vain."""
        if not rest:
            yield ()
            return
        i = min(i, bisect_right(sizes, rest))
        while i and reach[i] >> rest & 1:
            i -= 1
            s = sizes[i]
            for n in range(min(left[s], rest // s), 0, -1):
                if reach[i] >> rest - n * s & 1:
                    for tail in exact(i, rest - n * s):
                        yield (s,) * n + tail

    for waste in range(room + 1):
        if reach[-1] >> room - waste & 1:
            for rest in exact(len(sizes), room - waste):
                yield None if dominated(rest, left, waste) else (largest, *rest)


def lower_bound(have: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: by sum, and with what stands alone above half."""
    sizes = np.arange(len(have))
    best = -(-int((have * sizes).sum()) // capacity)
    for k in sorted({0, *np.flatnonzero(have[: capacity // 2 + 1]).tolist()})[:512]:
        big = int(have[capacity - k + 1 :].sum())
        mid = have[capacity // 2 + 1 : capacity - k + 1]
        room = int((mid * (capacity - sizes[capacity // 2 + 1 : capacity - k + 1])).sum())
        small = int((have[k : capacity // 2 + 1] * sizes[k : capacity // 2 + 1]).sum())
        best = max(best, big + int(mid.sum()) + max(0, -(-(small - room) // capacity)))
    return best


def plan(counts: dict[int, int], capacity: int, steps: int = 20_000) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, for all pieces.

    Depth first; a filling is used as often as its pieces and the waste that is allowed admit, and then once. As a bad choice
    near the root is reached last, searches that go back to fewer choices at each place come first. `steps` bounds the fillings
    looked at in all; the best plan so far is kept.
    """
    have = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        have[size] = n
    incumbent = best_fit(counts, capacity)
    best, bound = sum(n for _, n in incumbent), lower_bound(have, capacity)
    total = int((have * np.arange(capacity + 1)).sum())
    for width in (*WIDTHS, None):
        if best > bound and total:
            limit = steps if width is None else steps // (2 * len(WIDTHS))
            looked, found = _search(have.copy(), total, capacity, best, bound, width, limit)
            steps -= looked
            if found:
                best, incumbent = sum(n for _, n in found), found
    return incumbent


def _search(have: np.ndarray, total: int, capacity: int, best: int, bound: int, width: int | None, steps: int) -> tuple[int, list | None]:
    """How many fillings were looked at, and the best plan of fewer than `best` sequences."""
    done: list = []  # filling, times, of the branch at hand
    used = waste = packed = looked = 0
    found, ways = None, [[0, None]]  # at each place, how many ways were gone, and those that are left

    def use(filling: tuple[int, ...], times: int) -> None:
        nonlocal used, waste, packed
        for s in filling:
            have[s] -= times
        used, waste, packed = used + times, waste + times * (capacity - sum(filling)), packed + times * sum(filling)

    while ways and best > bound and looked < steps:
        if len(done) == len(ways):
            use(done[-1][0], -done[-1][1])
            done.pop()
        looked += 1
        if ways[-1][1] is None:
            ways[-1][1] = islice(_ways(have, capacity, width), ways[-1][0], None)
        ways[-1][0] += 1
        filling, times = next(ways[-1][1], (None, 0))
        allowed = (best - 1) * capacity - total - waste  # to beat the incumbent
        if filling is None or filling and capacity - sum(filling) > allowed:
            ways.pop()
            continue
        if not filling:
            continue
        spare = capacity - sum(filling)
        times = min(times, allowed // spare) if spare else times
        done.append((filling, times))
        use(filling, times)
        if packed < total:
            ways.append([0, None])
            if len(ways) > OPEN:  # those further up are made again when it comes to them, for memory's sake
                ways[-OPEN - 1][1] = None
        else:
            best, found = used, list(done)
    return looked, found


def _ways(have: np.ndarray, capacity: int, width: int | None) -> Iterator[tuple[tuple[int, ...], int]]:
    """Fillings and times to go on with, `width` of them or all; an empty filling for one that is dominated."""
    have, seen = have.copy(), set()
    for filling in fillings(have, capacity):
        if filling is None:
            yield (), 0
            continue
        if width and filling[1:2] in seen:  # few choices, and of different second pieces
            yield (), 0
            continue
        seen.add(filling[1:2])
        most = min(int(have[s]) // n for s, n in Counter(filling).items())
        yield filling, most
        if most > 1 and not width:
            yield filling, 1
        if len(seen) == width:
            return


def _cutter(tokenizer: str, end_id: int, capacity: int):
    def cut(batches):
        encode, end = tokens.encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        for rows in common.slices(batches, 2_500_000):
            out: tuple = ([], [], [], [], [], [])
            for d, c, x in zip(rows.column("doc_id").to_pylist(), rows.column("copy").to_pylist(), encode(rows.column("text").to_pylist()), strict=True):
                x += end
                n, at, piece = len(x) // 4, 0, 0
                size = n % capacity or capacity
                while at < n:
                    for column, v in zip(out, (d, c, piece, at, size, zlib.crc32(memoryview(x)[4 * at : 4 * (at + size)])), strict=True):
                        column.append(v)
                    at, piece, size = at + size, piece + 1, capacity
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    return cut


def _placer(layout: dict[int, tuple]):
    """Finds each piece's sequence and place there by its length and rank."""

    def place(batches):
        common.cache("places")  # the encoder goes: it isn't asked any more
        common.give_back()
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length).tolist():
                rows = np.flatnonzero(length == size)
                firsts, bases, each, starts = layout[size]
                at = np.searchsorted(firsts, rank[rows], "right") - 1
                k = rank[rows] - firsts[at]
                sequence[rows] = bases[at] + k // each[at]
                offset[rows] = starts[at] + k % each[at] * size
            out = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*out, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def layout(fillings_: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple]:
    """For each length: first rank, first sequence, how many in a sequence, and where they start, for each filling."""
    rows, base = defaultdict(list), 0
    ranks: Counter = Counter()
    for filling, times in fillings_:
        at = 0
        for size, n in sorted(Counter(filling).items(), reverse=True):
            rows[size].append((ranks[size], base, n, at))
            ranks[size] += n * times
            at += n * size
        base += times
    return {size: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for size, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, steps: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    rows = common.columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("copy", F.monotonically_increasing_id())  # only to break ties among repeated rows
    pieces = common.stored(rows.mapInArrow(_cutter(tokenizer, end_id, capacity), PIECE), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    chosen = layout(plan(counts, capacity, steps))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(common.partitions(docs.sparkSession))))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "copy", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(w) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).cast("long").alias("rank"))
    return ranked.mapInArrow(_placer(chosen), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
