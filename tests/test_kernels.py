"""Alignment kernels against plain dynamic programming, and consensus and partitioning on small cases."""

import random
import time

import numpy as np

from strandweave.functions import align as k
from strandweave.operators import contigs, partition, refine


def naive(a, b, free):
    n, m = len(a), len(b)
    s = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 or j == 0:
                s[i][j] = 0 if free else -2 * (i + j)
            else:
                s[i][j] = max(s[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), s[i - 1][j] - 2, s[i][j - 1] - 2)
    return max([*s[n], *(r[m] for r in s)]) if free else s[n][m]


def dna(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def test_alignment_scores():
    rng = random.Random(0)
    for _ in range(150):
        a, b = dna(rng, rng.randint(0, 14)), dna(rng, rng.randint(0, 14))
        for free in (False, True):
            x = k.align(a, b, free_ends=free, rows=True)
            assert x.score == naive(a, b, free)
            assert x.a_row.replace("-", "") == a[x.a_start : x.a_end] and x.b_row.replace("-", "") == b[x.b_start : x.b_end]
            if not free:
                assert (x.a_start, x.a_end, x.b_start, x.b_end) == (0, len(a), 0, len(b))
        assert k.align(a, b, band=20).score == naive(a, b, False)


def test_trimmed_columns():
    x = k.align("ACGTACGT", "TCGTACGA", trim_start=1, trim_end=1)
    assert (x.length, x.mismatches) == (6, 0)


def test_chain():
    seeds = [(0, 0, 10), (11, 11, 10), (5, 40, 22), (30, 30, 5), (12, 2, 10)]
    assert k.chain(seeds) == [(0, 0, 10), (11, 11, 10), (30, 30, 5)]
    assert k.chain([]) == []


def test_extension_finds_the_overlap():
    rng = random.Random(1)
    genome = dna(rng, 400)
    a, b = genome[:200], genome[120:320]
    x = k.extend(a, b, [(140, 20, 22)])
    assert (x.length, x.mismatches, x.a_start, x.a_end, x.b_start, x.b_end) == (80, 0, 120, 200, 0, 80)
    c = b[:40] + ("A" if b[40] != "A" else "C") + b[41:]
    assert k.extend(a, c, [(140, 20, 20)]).mismatches == 1


def test_extend_over_gaps_at_the_ends():
    rng = random.Random(5)
    b = dna(rng, 300)
    for gap in (1, 3, 6):
        for a, c in ((b[:200] + b[200 + gap :], b), (b, b[:200] + b[200 + gap :]), (b[: 260 + gap][gap:], b[:200] + b[200 + gap : 290])):
            at = c.index(a[100:122])
            x = k.extend(a, c, [(100, at, 22)])
            assert x.mismatches <= gap and x.a_end <= len(a) and x.b_end <= len(c) and (x.a_end == len(a) or x.b_end == len(c))
    assert k.extend(b[:100], b[:100], [(40, 40, 22)]).length == 100


def test_many_pairs_as_each_alone():
    rng, cases = random.Random(5), []
    while len(cases) < 400:
        base = "".join(rng.choices("ACGT" if rng.random() < 0.7 else "AC", k=rng.choice([30, 80, 200])))
        a, b = base[rng.randrange(10) : rng.randrange(25, len(base) + 1)], base[rng.randrange(len(base) - 20) :]
        rate = rng.choice([0, 0.01, 0.03, 0.1])
        b = "".join(c if rng.random() > rate else rng.choice(["", c + rng.choice("ACGT"), rng.choice("ACGT")]) for c in b)
        b = "".join(rng.choices("ACGT", k=rng.choice([0, 0, 5, 60]))) + b + "".join(rng.choices("ACGT", k=rng.choice([0, 0, 5, 60])))
        a, b = (a, b) if rng.random() < 0.5 else (b, a)
        if seeds := k.chain([(i, j, 8) for i in range(0, len(a) - 8, 5) if (j := b.find(a[i : i + 8])) >= 0]):
            cases.append((a, b, seeds))
    raw = np.frombuffer("".join(a + b for a, b, _ in cases).encode(), np.uint8)
    n, m = (np.array([len(c[i]) for c in cases]) for i in range(2))
    at = np.cumsum(n + m) - n - m
    upto = np.concatenate([[0], np.cumsum([len(c) for *_, c in cases])])
    q, r, w = (np.array([s[i] for *_, c in cases for s in c]) for i in range(3))
    each = [k.extend(a, b, c, 90.0) for a, b, c in cases]
    want = [(x.length, x.mismatches, x.a_start, x.a_end, x.b_start, x.b_end) for x in each]
    assert list(zip(*(v.tolist() for v in k.extend_many(raw, at, n, at + n, m, upto, q, r, w, 90.0)), strict=True)) == want
    x, y = np.maximum(0, (q - r)[upto[:-1]]), np.maximum(0, (r - q)[upto[:-1]])
    want = [k.passes_qgrams(a[i:][: len(b)], b[j:], 90.0) for (a, b, _), i, j in zip(cases, x.tolist(), y.tolist(), strict=True)]
    assert 0 < sum(want) < len(want)
    assert k.passes_qgrams_many(raw, at + x, np.minimum(n - x, m), at + n + y, m - y, 90.0).tolist() == want
    none = np.zeros(0, np.int64)
    assert not any(len(v) for v in k.extend_many(np.zeros(0, np.uint8), none, none, none, none, np.zeros(1, np.int64), none, none, none))


def test_qgrams():
    rng = random.Random(2)
    a = dna(rng, 150)
    assert k.passes_qgrams(a, a, 90) and not k.passes_qgrams(a, dna(rng, 150), 90)


def test_consensus_of_tiles():
    rng = random.Random(3)
    genome = dna(rng, 300)
    seqs = {i: genome[10 * i : 10 * i + 100] for i in range(21)}
    seq, flags, places = refine.consensus(list(range(21)), seqs)
    assert seq == genome and set(flags) == {"$"} and places == {i: 10 * i for i in range(21)}


def test_consensus_flags_a_variant():
    a, b = "ACGTACGTAC", "ACGTTCGTAC"
    seq, flags, _ = refine.consensus([0, 1, 2, 3, 4, 5], dict(enumerate([a, a, a, a, b, b])))
    assert seq == a and flags == "$$$$@$$$$$"


def test_cluster_graph():
    edge = {"s_contained": False, "d_contained": False, "r_dovetail": True}
    link = lambda pairs: {a: {b: edge for x, b in pairs if x == a} for a, _ in pairs}
    assert refine.reduce_transitive({1: {2, 3}, 2: {3}}) == {1: {2}, 2: {3}}
    rng = random.Random(4)
    seqs = {i: dna(rng, 20) for i in range(12)}
    assert refine.linearise({1, 2, 3}, link([(3, 2), (2, 1), (3, 1)]), seqs) == [[1, 2, 3]]
    assert refine.paths_of({1, 2, 3, 4}, {1: {2, 3}, 2: {4}, 3: {4}}) == [[1], [2], [3], [4]]
    seqs[3] = seqs[2]
    nodes, forward = refine.pop_bubbles({1, 2, 3, 4}, {1: {2, 3}, 2: {4}, 3: {4}}, seqs)
    assert len(nodes) == 3 and refine.paths_of(nodes, forward) == [sorted(nodes)]
    chain = {i: {i + 1} for i in range(9)} | {4: {5, 10}}
    left, _ = refine.trim_dead_ends(set(range(11)), chain, 3)
    assert left == set(range(10))
    both = {"s_contained": True, "d_contained": False, "r_dovetail": False}
    assert refine.remove_contained({1, 2}, {1: {2: both}}) == {2}


def test_swaps_look_at_every_pair():
    """Eighty nodes a side: the ones that gain most are neighbours, so that the best swap isn't among the first. Against all pairs."""
    rng = random.Random(6)
    for _ in range(3):
        adjacent = {n: {} for n in range(160)}
        for a in range(160):
            for b in range(a):
                if rng.random() < (0.9 if (a < 80) != (b < 80) and a % 80 < 70 and b % 80 < 70 else 0.1):
                    adjacent[a][b] = adjacent[b][a] = float(rng.randint(1, 9))
        side = {n: int(n >= 80) for n in adjacent}
        after = partition.kernighan_lin(dict.fromkeys(side, 1), adjacent, side, patience=1)
        want, free = dict(side), set(side)
        while True:
            gain = {n: sum(w if want[m] != want[n] else -w for m, w in adjacent[n].items()) for n in want}
            g, a, b = max((gain[a] + gain[b] - 2 * adjacent[a].get(b, 0), -a, -b) for a in free for b in free if want[a] < want[b])
            if g <= 0:
                break
            want[-a], want[-b] = 1, 0
            free -= {-a, -b}
        assert after == want


def test_bisection_of_two_cliques():
    adjacent = {a: {b: 10.0 for b in range(5) if b != a} for a in range(5)}
    adjacent |= {a: {b: 10.0 for b in range(5, 10) if b != a} for a in range(5, 10)}
    adjacent[0][5] = adjacent[5][0] = 1.0
    weights = dict.fromkeys(range(10), 1)
    side = partition.kernighan_lin(weights, adjacent, partition.grow_halves(weights, adjacent))
    assert partition._cut(side, adjacent) == 1.0
    mixed = partition.kernighan_lin(weights, adjacent, {n: n % 2 for n in range(10)})
    assert partition._cut(mixed, adjacent) <= partition._cut({n: n % 2 for n in range(10)}, adjacent)


def test_contigs():
    rng = random.Random(5)
    g = dna(rng, 600)
    assert contigs.covers(g[100:220], g) and not contigs.covers(dna(rng, 120), g)
    assert contigs.stitch(g[:300], g[250:]) == g and contigs.stitch(g[:300], dna(rng, 200)) is None


def test_swaps_of_many_nodes_that_gain_alike():
    """Nodes without edges all gain the same: their pairs are not gone through one by one for each swap."""
    n = 8000
    adjacent = {i: {i + 1: 3, i + 2: 3} for i in range(0, 30, 3)} | {i + 1: {i: 3} for i in range(0, 30, 3)} | {i + 2: {i: 3} for i in range(0, 30, 3)}
    began = time.process_time()
    side = partition.kernighan_lin(dict.fromkeys(range(n), 1), adjacent, {i: i % 2 for i in range(n)})
    assert time.process_time() - began < 10
    assert partition._cut(side, adjacent) == 0
    assert sum(side.values()) == n // 2
