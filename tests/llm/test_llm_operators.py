"""Each operator against brute force on small tables that hold the awkward cases."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandweave.llm import audio, common, language_id, mixing, neighbours, packing, queries, shingle_join, suffix_dedup, token_cache, token_files, tokens, url_filter

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, size string, row string"


def make(spark, rows):
    """Rows (doc_id, text, lang, source) as documents, with columns whose names clash with the operators' own."""
    full = [(i, t, lang, s, None if t is None else len(t), "x", "y", "z", "w") for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def sample(seed=0, n=60):
    """Documents with copies, near copies, shared passages, repeats, nulls, empty and very long texts, and a repeated row."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg é", k=rng.randint(1, 9))).strip() or "a"
    prose = lambda k: " ".join(word() for _ in range(k))
    passage = prose(120)
    out = [(0, None, "en", None), (1, "", "en", "a"), (2, "one two", None, "b"), (3, "One two", "fr", "b"), (4, "   \n\t", "en", "a")]
    base = prose(200).split(" ")
    for i in range(5, n):
        kind = i % 6
        if kind == 0:
            text = " ".join(base)
        elif kind == 1:
            copy = list(base)
            for _ in range(rng.randint(1, 6)):
                copy[rng.randrange(len(copy))] = word()
            text = " ".join(copy)
        elif kind == 2:
            text = prose(30) + "\n" + passage + "\n" + prose(40)
        elif kind == 3:
            x = prose(100)
            text = x + " " + prose(3) + " " + x
        else:
            text = prose(rng.randint(1, 300))
        out.append((i * 3, text, rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", None])))
    out.append((1000, prose(5000), "en", "c"))
    out.append(out[-2])
    return out


def collect(df):
    return [r.asDict() for r in df.collect()]


# 1


def test_url_rules_and_model(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1", "http://www.Example.com/en/x?y#z", "http://a.net/es/1", "http://net/fr/", "http://net.org/fr/", "http://a.com", "x://b.com?q=/en/", "http://" + "a" * 5000 + ".net/fr/"]
    urls += [f"http://{rng.choice('abc')}{i}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{i}" for i in range(200)]
    pages = spark.createDataFrame([(i, u, "host", "rule") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in collect(url_filter.judge(pages, queries.RULES, trees=3))}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            raw = re.match(r"[^/?#]*", rest)[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
            path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best.text)
        assert got[i]["verdict"] in ("allow", "block") and 0 <= got[i]["score"] <= 1
        if best:
            assert got[i]["verdict"] == best.verdict
    assert url_filter.judge(pages.limit(0), queries.RULES).count() == 0


def test_url_model_learns(spark):
    rows = [(i, f"http://h{i % 7}.{'bad' if i % 2 else 'good'}/{'9' * (i % 5 + (5 if i % 2 else 0))}", i % 2) for i in range(400)]
    df = url_filter.split_url(spark.createDataFrame(rows, "page_id long, url string, label long"))
    model = url_filter.fit(df, trees=4)
    scored = df.select("label", (model.margin(url_filter.features(model)) > 0).alias("bad")).collect()
    assert np.mean([r.label == r.bad for r in scored]) > 0.98


# 2


def brute_repeats(rows, length):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = defaultdict(int)
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for (i, *_), b in zip(rows, data, strict=True):
        m = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                m[k : k + length] = True
        kept = bytes(x for x, y in zip(b, m, strict=False) if not y)
        out.append((i, len(b), int(m.sum()), int((m[1:] & ~m[:-1]).sum() + m[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "hot"), [(40, 4096), (40, 2), (100, 8), (31, 5)])
def test_suffix_dedup(spark, length, hot):
    rows = sample(length)
    got = suffix_dedup.dedup(make(spark, rows), length, hot)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute_repeats(rows, length)


def test_suffix_dedup_bytes(spark):
    """Zero bytes, runs of one letter, and matches that end at a document's ends."""
    rows = [(i, t, None, None) for i, t in enumerate(["\0" * 90, "\0" * 50 + "x", "a" * 100, "b" + "a" * 60, "ab" * 40, "x" + "ab" * 30, "é" * 50, "né" * 5 + "é" * 30])]
    got = suffix_dedup.dedup(make(spark, rows), 40)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute_repeats(rows, 40)
    assert suffix_dedup.dedup(make(spark, []), 40).count() == 0


def test_loser_tree_and_front_coding():
    rng = random.Random(3)
    runs = [sorted("".join(rng.choices("ab", k=rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 20))) for _ in range(7)]
    coded = [suffix_dedup.decode_run(suffix_dedup.encode_run(r, [b"l"] * len(r), [[(1, 2, 3)]] * len(r))) for r in runs]
    assert [c[0] for c in coded] == runs
    got = [(coded[r][0][i], p) for r, i, p in suffix_dedup.merge([(c[0], c[1]) for c in coded])]
    assert [s for s, _ in got] == sorted(s for r in runs for s in r)
    assert all(p == suffix_dedup._common_prefix(a[0], b, 0) for a, (b, p) in zip(got, got[1:], strict=False))


# 3


def test_audio(spark):
    rng = np.random.default_rng(0)
    vectors = [rng.normal(size=64).tolist() for _ in range(12)]
    tones = [audio.tones(v) for v in vectors]
    # A recording that begins later, one at half the volume, a null, an empty one and an odd byte.
    shifted, quiet = tones[0][2 * 256 * 8 :], (np.frombuffer(tones[1], "<i2") // 2).astype("<i2").tobytes()
    rows = [(i, t, 8192, "x") for i, t in enumerate(tones)] + [(20, shifted, 8192, "x"), (21, quiet, 8192, "x"), (22, None, 8192, "x"), (23, b"", None, "x"), (24, b"\1", 8192, "x"), (0, tones[0], 8192, "x")]
    media = spark.createDataFrame(rows, "media_id long, audio binary, rate int, print string").repartition(3)
    got = collect(audio.align_recordings(media))
    comp = {r["media_id"]: r["component_id"] for r in got}
    prints = {i: audio.fingerprint(a, r) if r else np.zeros(0, np.uint32) for i, a, r, _ in rows}
    want = {i: i for i in prints}
    for i in sorted(prints):
        for j in sorted(prints):
            if i < j and len(prints[i]) and len(prints[j]) and audio.linked(prints[i], prints[j], 8, 0.15, 0.5):
                want[j] = min(want[j], want[i])
    assert comp == want and comp[20] == 0 and comp[21] == 1 and len(got) == len(rows)
    assert audio.align_recordings(media.limit(0)).count() == 0


def test_audio_noisy_copies(spark):
    """Copies with bit errors that leave hardly a run of equal integers, short ones and long, against all pairs."""
    rng = np.random.default_rng(7)
    prints = []
    for n, share in ((46, 0.03), (110, 0.05), (110, 0.02), (128, 0.05), (129, 0.05), (1000, 0.08), (1000, 0.05)):
        base = rng.integers(0, 2**32, n, dtype=np.uint32)
        prints.append(base)
        for skip in (0, 0, n // 5):
            noise = np.packbits(rng.random((n, 32)) < share, axis=1).view(np.uint32).ravel()
            prints.append((base ^ noise)[skip:])
    long = rng.integers(0, 2**32, 1000, dtype=np.uint32)
    prints += [long, long[300:400] ^ np.where(rng.random(100) < 0.2, 0, 1 << rng.integers(0, 32, 100)).astype(np.uint32)]
    runs, pairs = 0, []
    for i in range(len(prints)):
        for j in range(i):
            if audio.linked(prints[j], prints[i], 8, 0.15, 0.5):
                pairs.append((j, i))
                at = lambda p: {p[k : k + 4].tobytes() for k in range(len(p) - 3)}
                runs += bool(at(prints[j]) & at(prints[i]))
    assert len(pairs) >= 25 and runs < len(pairs) / 2
    want = list(range(len(prints)))
    for _ in prints:
        for j, i in pairs:
            want[i] = want[j] = min(want[i], want[j])
    nodes = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(prints)], "node long, print binary").repartition(3)
    got = dict(audio.components_of_prints(nodes).collect())
    label = [got.get(i, i) for i in range(len(prints))]
    assert [label.index(x) for x in label] == want


def test_audio_few_different_integers(spark):
    """Recordings made of few integers, silent ones and near copies, against all pairs."""
    rng = np.random.default_rng(3)
    prints = [np.zeros(n, np.uint32) for n in (5, 8, 30)]
    for n, kinds in ((12, 3), (40, 4), (40, 30), (150, 6), (60, 60)):
        base = rng.integers(0, 2**32, kinds, dtype=np.uint32)[rng.integers(0, kinds, n)]
        other = base.copy()
        other[rng.random(n) < 0.3] ^= np.uint32(1)
        prints += [base, other, rng.permutation(base), base[n // 3 :]]
    want = list(range(len(prints)))
    for _ in prints:
        for i in range(len(prints)):
            for j in range(i):
                if audio.linked(prints[j], prints[i], 8, 0.15, 0.5):
                    want[i] = want[j] = min(want[i], want[j])
    nodes = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(prints)], "node long, print binary").repartition(3)
    got = dict(audio.components_of_prints(nodes).collect())
    label = [got.get(i, i) for i in range(len(prints))]
    assert [label.index(x) for x in label] == want and len(set(want)) > 5


def test_audio_keys_of_two_recordings_are_settled_by_their_pair(spark, monkeypatch):
    """Only keys of three recordings and more are labelled; a pair of unlinked recordings is not compared once more."""
    rng = np.random.default_rng(9)
    shared, more = (rng.integers(0, 2**32, 9, dtype=np.uint32) for _ in range(2))
    alone = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    prints = [np.concatenate([shared, alone(90)]), np.concatenate([alone(90), shared])]
    prints += [np.concatenate(x) for x in ([more, alone(90)], [alone(40), more, alone(50)], [alone(90), more])]
    nodes = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(prints)], "node long, print binary")
    met, labelled = [], audio._labelled
    monkeypatch.setattr(audio, "_labelled", lambda *x: (met.append(labelled(*x)), met[-1])[1])
    assert audio.components_of_prints(nodes).count() == 0
    assert {r.node for r in met[0].collect()} == {2, 3, 4}


# 4


def brute_jaccard(rows, words, num, den):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    root = lambda x: x if label[x] == x else root(label[x])
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((root(i), root(j)), key=lambda k: (rows[k][0], k))
                label[b] = a
    return sorted((r[0], len(s), rows[root(i)][0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("words", "num", "seed"), [(4, 85, 0), (5, 80, 1), (1, 60, 2), (2, 70, 3)])
def test_jaccard(spark, words, num, seed):
    rows = sample(seed, 90)
    got = shingle_join.jaccard_components(make(spark, rows), words, num, 100)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute_jaccard(rows, words, num, 100)


def test_jaccard_families(spark, monkeypatch):
    """Families whose members are near the threshold, so that leaders settle few of them and groups must be opened."""
    rng = random.Random(5)
    rows = []
    for f in range(3):
        base = [f"w{f}_{i}" for i in range(60)]
        for m in range(60):
            copy = list(base)
            for i in rng.sample(range(60), rng.randint(2, 10)):
                copy[i] = f"x{rng.randrange(10**6)}"
            rows.append((f * 1000 + m, " ".join(copy), "en", "a"))
    rows.append((5000, " ".join(f"w0_{i}" for i in range(30)), "en", "a"))
    got = shingle_join.jaccard_components(make(spark, rows), 1, 80, 100)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute_jaccard(rows, 1, 80, 100)
    assert shingle_join.jaccard_components(make(spark, []), 4, 85, 100).count() == 0


# 5, 6, 10


def reference_ids(rows):
    t = Tokenizer.from_file(BPE)
    return [t.encode(x or "", add_special_tokens=False).ids for _, x, *_ in rows]


def test_encoder_equals_the_library():
    rng = random.Random(0)
    parts = ["a", "bc", " ", " ", "\n", ".", ",", "'s", "1", "é", "\t", "<|endoftext|>", "²", "\x1c", "\u00a0", "中", "\r", "word"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 15))) for _ in range(3000)] + [None, "x" * 100 + " " + "y" * 100]
    t = Tokenizer.from_file(BPE)
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    for kept in (10**6, 10):
        assert tokens.Encoder(BPE, kept).encode(texts) == want
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        e = tokens.Encoder(public_tokenizers.path(name))
        assert not e.chunked and e.encode(["Some text", None])[0]


def test_encoder_cuts_runs_of_marks_off_and_keeps_common_words():
    rng = random.Random(1)
    parts = ["a", "é", "É", "×", "÷", "ñ", "中", "7", "'", "'ll", "%%%", ".", ",", "_", "-", " ", " ", "\n", "&" * 70]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 15))) for _ in range(3000)]
    t = Tokenizer.from_file(BPE)
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    for kept in (10**6, 10):
        e = tokens.Encoder(BPE, kept)
        assert [x for i in range(0, 3000, 100) for x in e.encode(texts[i : i + 100])] == want
    e = tokens.Encoder(BPE)
    e.encode(["word word. word.%%% word*** añé,*** a×**"])
    assert set(e.index) == {x.encode() for x in ("word", "añé", "a×**", "\n", ".", ".%%%", "***", ",***")}
    e, met = tokens.Encoder(BPE, 20), []
    learn = e._learn
    e._learn = lambda keys, words, prefix: (met.extend(words), learn(keys, words, prefix))
    for i in range(12):
        e.encode([" ".join(["common", *(f"w{i}x{j}" for j in range(9))])])
    assert met.count(b"common") == 1 and len(met) == 1 + 12 * 9 and len(e.index) < 60


def test_encoder_takes_bounded_memory_and_is_dropped_by_the_placer():
    texts = [" ".join(f"w{i % 500}" for i in range(j, j + 2000)) for j in range(500)]
    e = tokens.Encoder(BPE)
    e.encode(texts[:3])
    tracemalloc.start()
    for _ in e.steps(texts):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50_000_000
    tokens.encoder(BPE)
    assert list(packing._placer({})(iter([]))) == [] and "tokens" not in common._CACHES


def test_encoder_finds_odd_texts_among_others():
    odd = ["a\tb", "a\u0085b", "a\u00a0b", "\u1680", "a\u2003", "\u2028b", "a\u3000", "<|endoftext|>", "\x1d"]
    plain = ["¿a?", "â", "“a”", "中。", "á\u0300", "", "a b\nc", "ends with Â", "ends with ã"]
    e = tokens.Encoder(BPE)
    texts = [t for pair in zip(odd, plain, strict=True) for t in pair]
    assert [texts[i] for i in e._odd(texts, [t.encode() for t in texts])] == odd


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 5000):
        for top in (1, 2, 300, 50_000, 2**32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.random(n) < 0.03] = 2**32 - 1
            packed = token_files.pack(ids)
            assert (token_files.unpack(packed) == ids).all()
            assert (token_files.unpack(packed, 1, 2) == ids[256:512]).all()


def test_token_files(spark, tmp_path):
    rows = sample(7)
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(make(spark, rows), path, BPE, 2)
    got = sorted(tuple(r) for r in token_files.read_token_files(spark, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    ids = [x + [2] for x in reference_ids(rows)]
    at, want = 0, []
    for (i, t, *_), x in sorted(zip(rows, ids, strict=True), key=lambda p: (p[0][0], p[0][1] or "")):
        want.append((at, i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert got == want


def test_token_cache(spark, tmp_path):
    rows = sample(8)
    cache = f"file://{tmp_path}/cache"
    want = sorted((r[0], len((r[1] or "").encode()), len(x), len(x) > 50) for r, x in zip(rows, reference_ids(rows), strict=True))
    for _ in range(2):
        got = token_cache.token_counts(make(spark, rows), BPE, cache, 50)
        assert sorted(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want
    stored = spark.read.parquet(f"{cache}/{token_cache.version_digest(BPE)}")
    assert stored.count() == len({r[1] or "" for r in rows})  # the second call added nothing


def test_packing(spark):
    rows = sample(9) + [(2000 + i, "word " * i, "en", "a") for i in range(120)]
    got = collect(packing.pack(make(spark, rows), BPE, 0, 64))
    ids = defaultdict(list)
    for r, x in zip(rows, reference_ids(rows), strict=True):
        ids[r[0]].append(x + [0])
    for g in got:
        assert any(zlib.crc32(np.array(x[g["start"] : g["start"] + g["length"]], "<u4").tobytes()) == g["ids_crc32"] for x in ids[g["doc_id"]])
    assert sum(g["length"] for g in got) == sum(len(x) for xs in ids.values() for x in xs)
    bins = defaultdict(list)
    for g in got:
        bins[g["sequence_id"]].append((g["offset"], g["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    counts = Counter(g["length"] for g in got)
    have = np.array([counts.get(i, 0) for i in range(65)])
    assert packing.lower_bound(have, 64) <= len(bins) <= sum(n for _, n in packing.best_fit(counts, 64))
    assert len(bins) <= 1.005 * packing.lower_bound(have, 64) + 1
    assert packing.pack(make(spark, []), BPE, 0, 64).count() == 0


def test_bin_completion_beats_best_fit():
    rng = random.Random(0)
    for _ in range(30):
        counts = {rng.randint(1, 100): rng.randint(1, 4) for _ in range(25)}
        plan = packing.plan(counts, 100)
        assert sorted((s, n) for s, n in counts.items()) == sorted((s, sum(f.count(s) * n for f, n in plan)) for s in counts)
        assert all(sum(f) <= 100 for f, _ in plan)
        assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, 100))


def test_fillings_are_the_undominated_ones():
    """Against all fillings, each held against all others."""
    rng = random.Random(1)

    def gives_way(f, g):
        """Whether the pieces of g can be cut into those of f."""
        if not f:
            return True
        return any(f[0] <= x and gives_way(f[1:], [*g[:i], x - f[0], *g[i + 1 :]]) for i, x in enumerate(g))

    for _ in range(60):
        capacity = rng.randint(8, 24)
        have = np.zeros(capacity + 1, np.int64)
        for _ in range(rng.randint(1, 9)):
            have[rng.randint(2, capacity)] += rng.randint(1, 3)
        largest = int(np.flatnonzero(have)[-1])
        left = [s for s in range(capacity, 0, -1) for _ in range(have[s] - (s == largest))]
        every = {()}
        for s in left:
            every |= {(*f, s) for f in every if sum(f) + s <= capacity - largest}
        want = {f for f in every if not any(g != f and gives_way(list(f), list(g)) for g in every)}
        got = [f for f in packing.fillings(have, capacity) if f]
        assert sorted(f[1:] for f in got) == sorted(want) and all(f[0] == largest for f in got)
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


@pytest.mark.parametrize(
    ("capacity", "counts", "most"),
    [
        (100, {51: 100, 20: 100, 17: 100, 12: 100, 19: 1}, 101),
        (60, {32: 38, 21: 89, 48: 48, 54: 131, 17: 171, 19: 64, 51: 88, 11: 26, 60: 181, 13: 193, 10: 58, 34: 86, 12: 84}, 685),
    ],
)
def test_packing_of_few_lengths(capacity, counts, most):
    """A largest piece that is best filled by smaller ones than the first that fit; chains of the largest need 687."""
    plan = packing.plan(counts, capacity)
    assert sum(n for _, n in plan) <= most
    assert all(sum(f) <= capacity for f, _ in plan) and {s: sum(f.count(s) * n for f, n in plan) for s in counts} == counts
    assert packing.plan({}, capacity) == []
    have = np.bincount(list(counts), list(counts.values()), capacity + 1).astype(np.int64)
    if capacity == 100:
        assert (51, 20, 17, 12) in list(packing.fillings(have, capacity))


# 7


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(900, 16)).astype(np.float32)
    m[100:130] = m[5]
    rows = [(i, [float(x) for x in v], "c") for i, v in enumerate(m)]
    rows += [(2000, None, "c"), (2020, [0.0] * 16, "c"), (2040, [float("nan")] * 16, "c"), (2060, [1.0], "c"), (2080, [None] * 16, "c"), (2100, [float("inf")] * 16, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, class string").repartition(3)
    got = defaultdict(list)
    for r in neighbours.neighbours(df, 20, 20, trees=8, leaf=64).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    x = m.astype(np.float64)
    hits = 0
    assert sorted(got) == list(range(0, 900, 20))
    for q, found in got.items():
        found.sort()
        s = (x @ x[q]).round(12)
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert [(-round(f[2], 12), f[1]) for f in found] == sorted((-round(f[2], 12), f[1]) for f in found)
        assert all(abs(f[2] - x[q] @ x[f[1]]) < 1e-9 for f in found)
        hits += len(set(order) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)
    assert neighbours.neighbours(df.limit(0)).count() == 0
    few = neighbours.neighbours(df.filter("vec_id < 3"), 20, 2).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (2, 1), (2, 2)]


# 8


def test_targets():
    assert mixing.targets([10, 10, 10], [3, 1, 2]) == [20.0, 25 / 3, 50 / 3]
    assert mixing.targets([0, 0], [3, 1]) == [0.0, 0.0] and mixing.targets([], []) == []
    got = mixing.targets([100, 1, 50], [3, 1, 2])
    assert abs(sum(got) - 1.5 * 151) < 1e-9 and all(g <= 2 * s + 1e-9 for g, s in zip(got, [100, 1, 50], strict=True))


def test_mixing(spark):
    rows = sample(11, 200)
    got = collect(mixing.mix(make(spark, rows)))
    assert sorted(g["doc_id"] for g in got) == sorted(r[0] for r in rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = defaultdict(int)
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    for r in rows:
        want[r[3]] += size(r[1])
    goals = dict(zip(names, mixing.targets([want[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    by_id = defaultdict(set)
    for r in rows:
        by_id[r[0]].add((size(r[1]), r[3]))
    taken = defaultdict(int)
    for g in got:
        source = next(s for z, s in by_id[g["doc_id"]] if z == g["size"])
        assert g["source_size"] == want[source] and abs(g["target"] - goals[source]) < 1e-6 and 0 <= g["taken"] <= 2 * g["size"]
        taken[source] += g["taken"]
    for s in names:
        assert abs(taken[s] - goals[s]) <= 0.02 * goals[s] + 20
    again = collect(mixing.mix(make(spark, rows).repartition(5)))
    key = lambda g: (g["doc_id"], g["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(make(spark, [])).count() == 0


def test_mixing_meets_targets_of_small_sources(spark):
    """Sources far below a block of the mix, beside a large one: each takes its target to the word."""
    rows = [(i, "w " * 40_000, "en", "large") for i in range(50)] + [(100 + i, "w " * (7 * i % 23 + 1), "en", f"s{i % 40:02}") for i in range(80)] + [(500, "w " * 90, "en", None)]
    got = collect(mixing.mix(make(spark, rows), slots=1 << 10))
    source = {r[0]: r[3] for r in rows}
    taken, target, passes = defaultdict(int), {}, defaultdict(set)
    for g in got:
        s = source[g["doc_id"]]
        taken[s] += g["taken"]
        target[s] = g["target"]
        passes[s].add(g["taken"] / g["size"])
    assert len(taken) == 42
    for s, n in taken.items():
        assert abs(n - target[s]) <= 0.5 + 1e-6
        # Whole passes and a part of one more: of one document at most a part is taken.
        assert max(passes[s]) <= int(min(passes[s])) + 1 and sum(p != int(p) for p in passes[s]) <= 1


def test_apply_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), "en", "ab"[i % 2]) for i in range(100)] + [(200, None, "en", "a"), (201, "", None, None)]
    docs = make(spark, rows)
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert dict(words) == {i: t for i, t in taken.items() if t}


def test_apply_mix_keeps_lines_and_cuts_one_document_a_source(spark):
    """A part of a document is a piece of its very text, and what the mix gave is in the output, word for word."""
    rows = [(i, "".join(f"{' '[: k % 2]}w{i}_{k}\n\t " for k in range(i % 7 + 40)), "en", "ab"[i % 2]) for i in range(60)]
    rows += [(i, "same  text\nhere", "en", s) for i in (300, 301) for s in "ab"]
    docs = make(spark, rows)
    text = {(r[0], r[3]): r[1] for r in rows}
    want = {}
    for s in "ab":  # the mix's order is by a hash of the id and the source's place
        for r in mixing.mix(docs.withColumn("o", docs["source"]), carry=("o",)).filter(f"o = '{s}'").collect():
            want[r.doc_id, s] = r.taken
    words, parts = Counter(), Counter()
    for r in mixing.apply_mix(docs).collect():
        whole = text[r.doc_id, r.source]
        words[r.doc_id, r.source] += len(r.text.split())
        assert whole.startswith(r.text) and r.n_chars == len(r.text)
        parts[r.source] += r.text != whole
    assert words == Counter(want) and 0 < max(parts.values()) <= 1


# 9


def test_language_id(spark):
    rng = random.Random(0)
    make_ = lambda parts: " ".join("".join(rng.choices(parts, k=3)) for _ in range(rng.randint(3, 120)))
    kinds = {"aa": ["th", "ing", "er"], "bb": ["sch", "ung", "ein"], "cc": ["ción", "ar", "os"]}
    rows = [(i, make_(kinds[k]), k, "s") for i, k in ((i, "abc"[i % 3] * 2) for i in range(600))]
    rows += [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 - 4", "bb", "s"), (1003, "thing", None, "s"), (None, "thinger", "aa", "s"), (1004, "ungein " * 50_000, "bb", "s")]
    docs = make(spark, rows)
    got = collect(language_id.predict(docs, language_id.fit(docs)))
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows)
    for g in got:
        assert 0 <= g["score"] <= 1
        assert g["held_out"] == (g["doc_id"] is not None and zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2)
    assert {g["doc_id"]: g["lang_pred"] for g in got if g["doc_id"] in (1000, 1001, 1002)} == {1000: "und", 1001: "und", 1002: "und"}
    held = [g for g in got if g["held_out"] and g["doc_id"] < 600]
    assert np.mean([g["lang_pred"] == truth[g["doc_id"]] for g in held]) > 0.97
    assert {g["lang_pred"] for g in collect(language_id.predict(docs, None))} == {"und"}
    kept = language_id.filter_known(docs, language_id.fit(docs))
    assert kept.columns == docs.columns and kept.filter("doc_id < 600").count() >= 590
    assert language_id.predict(make(spark, []), language_id.fit(make(spark, []))).count() == 0


# The pipeline.


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choices(["th", "ing", "er", "an"], k=3)) for _ in range(n))
    shared = prose(100)
    rows = [(i, prose(150), "en", "ab"[i % 2]) for i in range(80)]
    rows += [(100 + i, f"{prose(60)} {shared} {prose(60)}", "en", "a") for i in range(3)]
    rows += [(200, rows[0][1], "en", "b"), (201, rows[1][1] + " extra", "en", "b"), (202, "1234 5678", "en", "a"), (203, None, "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, None).write.parquet(path)
        out = spark.read.parquet(path)
        kept.append((name, out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    lang, join, strip, mix, packed = (df for _, df in kept)
    ids = lambda df: sorted({r.doc_id for r in df.collect()})
    assert ids(lang) == sorted(r[0] for r in rows if r[0] not in (202, 203))
    assert ids(join) == sorted(r[0] for r in rows if r[0] < 200)
    texts = {r.doc_id: r.text for r in strip.collect()}
    assert all(shared[20:-20] not in texts[100 + i] for i in range(3)) and texts[0] == rows[0][1]
    assert sum(len(r.text.split()) for r in mix.collect()) == pytest.approx(1.5 * sum(len(t.split()) for t in texts.values()), rel=0.02)
    assert packed.count() and packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_pipeline_null_and_repeated_ids(spark):
    """Different texts under one id, or under none, are different documents; a group leaves one row whatever its ids."""
    import corpus_pipeline

    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices(["th", "ing", "er", "an"], k=3)) for _ in range(n))
    t = [prose(80) for _ in range(12)]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (7, t[3]), (7, t[4]), (7, t[4] + " more"), (1, t[5]), (7, t[5] + " more"), (8, t[6]), (8, t[6]), (None, t[7]), (None, t[7]), (9, t[8] + " more"), (None, t[8])]
    rows += [(None, None), (None, None), (9, ""), (9, " "), (None, t[9]), (None, t[9] + " more")]
    docs = spark.createDataFrame([(i, x, "en", "a", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.one_of_each_group(spark, docs, None)
    assert got.columns == docs.columns
    out = Counter((r.doc_id, r.text) for r in got.collect())
    want = Counter([(None, t[0]), (None, t[1]), (None, t[2]), (7, t[3]), (1, t[5]), (8, t[6]), (None, t[7]), (9, t[8] + " more"), (None, None), (None, None), (9, ""), (9, " ")])
    for low in ((7, t[4]), (None, t[9])):  # either of the group's two texts, under the same id
        found = [k for k in out if k[0] == low[0] and k[1] in (low[1], low[1] + " more")]
        assert len(found) == 1
        want[found[0]] += 1
    assert out == want


# Cases that once went wrong


def test_long_texts_are_taken_in_pieces(monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choice(["ab", "c", "def\n", "\t g"]) + str(rng.randrange(60)) for _ in range(2000))
    want = [shingle_join.shingle_sets([t, "a", None, text[:40]], 4) for t in (text, "x" * 500)]
    monkeypatch.setattr(shingle_join, "_STEP", 90)
    for t, sets in zip((text, "x" * 500), want, strict=True):
        assert all(np.array_equal(a, b) for a, b in zip(shingle_join.shingle_sets([t, "a", None, text[:40]], 4), sets, strict=True))
    t = Tokenizer.from_file(BPE)
    monkeypatch.setattr(tokens, "_STEP", 200)
    texts = [text, "\n\n".join([text, text]), " " * 900, "é" * 900, text + " \n\n "]
    assert tokens.Encoder(BPE).encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_repeated_rows_cost_no_more_than_their_number(spark):
    """Equal rows, with and without ids, are named once; what is left of a text that has copies is nothing."""
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    rows = [(1, text, None, None)] * 30 + [(None, text, None, None)] * 3 + [(2, text[:90] + "q" * 20, None, None), (3, "alone", None, None)]
    got = sorted(((r.doc_id or 0, r.n_removed, r.text) for r in suffix_dedup.dedup(make(spark, rows), 80).collect()))
    assert got == [(0, 300, "")] * 3 + [(1, 300, "")] * 30 + [(2, 90, "q" * 20), (3, 0, "alone")]


def test_columns_of_any_name_go_through_the_stages(spark):
    """Columns with the names of the operators' own keep their values; null texts, repeated and null ids are kept apart."""
    names = ["_h", "_id", "_kept", "h", "h2", "row", "id2", "words", "copies", "score", "spans", "left", "label", "node"]
    rows = [(i, f"the cat number {i} sat on the mat and saw {i * 7} birds", "en", "a", 5, *[f"{n}{i}" for n in names]) for i in (1, 2, 3, 3)]
    rows += [(None, "another text that has no number at all but some words", "en", None, 5, *names), (9, None, "en", "a", 0, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    own = {tuple(r)[5:] for r in rows}
    for got in (suffix_dedup.strip_repeats(docs, 400), shingle_join.one_of_each(docs, 5, 80, 100), mixing.apply_mix(docs), language_id.filter_known(docs, language_id.fit(docs), 0.0)):
        assert got.columns == docs.columns
        found = got.collect()
        assert found and {tuple(r)[5:] for r in found} <= own
        assert got.limit(0).columns == docs.columns
    empty = docs.limit(0)
    for got in (suffix_dedup.strip_repeats(empty, 400), shingle_join.one_of_each(empty, 5, 80, 100), mixing.apply_mix(empty), language_id.filter_known(empty, None)):
        assert got.count() == 0


def test_letters():
    assert not any(language_id.has_letter(t) for t in ("", "12", "²", "½ ①", "Ⅷ", "_-", "٣"))
    assert all(language_id.has_letter(t) for t in ("a", "² é", "中", "½b"))


def test_neighbours_of_doubles_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x[10] = x[0]
    ids = [0, 0, *range(2, 60)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.neighbours(df, 5, 20, trees=4, leaf=16, recall=1.0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in (20, 40):
        s = x @ x[q]
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-(x[q] * x[i]).sum(), ids[i]))[:5]
        assert [(ids[i], float((x[q] * x[i]).sum())) for i in order] == [(v, s) for _, v, s in sorted(got[q])]
    assert len(got[0]) == 10  # two rows of that id, each a query
    assert sorted(v for _, v, _ in got[0]).count(10) == 1 + int(0 in sorted(range(60), key=lambda i: -(x[1] * x[i]).sum())[:6])


def test_tables_of_others_are_not_deleted(spark):
    import corpus_pipeline

    docs = make(spark, [(i, f"some words {i} that make up a text of {i} and more", "en", "a") for i in range(12)])
    unread = shingle_join.jaccard_components(docs)
    corpus_pipeline.STAGES[1][1](spark, docs, "").count()
    corpus_pipeline.STAGES[1][1](spark, docs, "").count()
    assert unread.count() == 12
