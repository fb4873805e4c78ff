"""Token ids of whole texts, with each distinct word encoded once per worker.

A byte-level BPE file with the usual pre-tokenizer cuts a text at white space, whatever the words are: of blanks and line
ends before a word, all but the last are a pre-token, the last one goes with the word if it is a blank and is a pre-token
of its own if not, and what stands at the end of the text is one pre-token. A run of ASCII punctuation marks at the end of
a word, after a letter of Latin-1 or an ASCII digit, is a pre-token too. So the words of many texts are cut out of their bytes by array
operations and made a dictionary; only words that the worker does not hold are encoded, and the ids of all are gathered.

Texts with other white space or with special strings are given to the library whole, as are those for files of other kinds.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_CLEAN = re.compile(r"(?<=\S) (?=\S)")
_ODD = r"[^\S \n]|[\x1c-\x1f]"
#: Bytes, and first two bytes, of white space besides blanks and line ends.
_ODD_BYTE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])
_ODD_PAIRS = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))
_ODD_FIRST = _ODD_BYTE | np.isin(np.arange(256), [a for a, _ in _ODD_PAIRS])
#: Characters of a step: a worker's arrays take about 30 bytes for each.
_STEP = 1_200_000
_TOGETHER = 256
_ALNUM = np.array([chr(c).isascii() and chr(c).isalnum() for c in range(256)])
_MARK = np.array([32 < c < 127 and not chr(c).isalnum() for c in range(256)])
#: Second bytes of the letters that begin with 0xC3: all but the signs of multiplication and division.
_LETTER_C3 = np.array([0x80 <= c < 0xC0 and c not in (0x97, 0xB7) for c in range(256)])
#: Longer runs of marks stay with their word, which the library cuts.
_MARKS = 64


def cuts_at_single_spaces(config: dict) -> bool:
    """Whether a tokenizers file is of the kind for which words are independent."""
    pre = config.get("pre_tokenizer") or {}
    return (
        config.get("normalizer") is None
        and config.get("post_processor") is None
        and config.get("truncation") is None
        and config.get("padding") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", False)
        and not pre.get("add_prefix_space", True)
        and not any(
            a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in config.get("added_tokens", [])
        )
    )


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers. `kept` bounds the words held in memory between steps."""

    def __init__(self, path: str, kept: int = 250_000):
        self.path, self.kept = path, kept
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: model.encode(list(texts), num_threads=1)
            self.chunked = False
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.whole = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                config = json.load(f)
            self.chunked = cuts_at_single_spaces(config)
            special = [a["content"] for a in config.get("added_tokens", [])]
            self.odd = re.compile("|".join([_ODD, *map(re.escape, special)]))
            self.special = [s.encode() for s in special]
            self.sizes = np.zeros(tokenizer.get_vocab_size() + 1, np.int64)  # bytes of each id: a character of its name stands for one
            for name, i in tokenizer.get_vocab(with_added_tokens=False).items():
                self.sizes[i] = len(name)
            newline = self.whole(["\n"])[0]
            self.newline = newline[0] if len(newline) == 1 else -1
        self.forget()

    def forget(self) -> None:
        """A word's ids: without and with a blank before it, from `start`, so many as `count` says (-1: not known)."""
        self.index: dict[bytes, int] = {}
        self.size = 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.full(1 << 12, -1, np.int32)
        self.seen = np.zeros(1 << 11, np.int32)  # steps that had a word
        self.ids, self.used = np.zeros(1 << 12, "<u4"), 0

    def _thin(self) -> None:
        """Forgets words, but for those that most steps had: half of `kept` at most, of two steps at least."""
        words = list(self.index)
        seen = self.seen[: len(words)]
        best = np.argsort(-seen, kind="stable")[: self.kept // 2]
        best = best[seen[best] > 1]
        best = best[np.cumsum([len(words[i]) for i in best.tolist()], dtype=np.int64) <= 50 * self.kept]
        keys = (2 * best[:, None] + np.arange(2)).ravel()
        start, count, ids, seen = self.start[keys], self.count[keys], self.ids, seen[best]
        self.forget()
        self.index = {words[i]: j for j, i in enumerate(best.tolist())}
        self.size = sum(map(len, self.index))
        self._places([])
        self.seen[: len(best)] = seen // 2
        known = np.flatnonzero(count >= 0)
        n = count[known].astype(np.int64)
        self._put(known, n, ids[np.repeat(start[known] - (np.cumsum(n) - n), n) + np.arange(n.sum())])

    # What is known.

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Where distinct words are kept; new ones get their places."""
        index = self.index
        new = [w for w in words if w not in index]
        index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
        self.size += sum(map(len, new))
        while 2 * len(index) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(len(self.start), np.int64)])
            self.count = np.concatenate([self.count, np.full(len(self.count), -1, np.int32)])
            self.seen = np.concatenate([self.seen, np.zeros(len(self.seen), np.int32)])
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        self.seen[at] += 1
        return at

    def _put(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), "<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[keys] = self.used + np.cumsum(counts) - counts
        self.count[keys] = counts
        self.used += len(ids)

    def _learn(self, keys: np.ndarray, words: list[bytes], prefix: bytes) -> None:
        """Words are encoded together, with blanks or line ends between them; the bytes of the ids tell where each ends."""
        between, sizes = prefix or b"\n", self.sizes
        for i in range(0, len(words), _TOGETHER):
            part, own = words[i : i + _TOGETHER], keys[i : i + _TOGETHER]
            ids = np.array(self.whole([(prefix + between.join(part)).decode()])[0], "<u4")
            upto = np.cumsum(sizes[ids])
            want = np.cumsum([len(w) + 1 for w in part]) - (not prefix)
            ends = np.searchsorted(upto, want)
            if ends[-1] >= len(ids) or (upto[ends] != want).any():
                self._learn_each(own, [(prefix + w).decode() for w in part])
                continue
            ends += 1
            counts = np.diff(ends, prepend=0)
            if not prefix:  # each word but the first comes after a line end
                if (ids[ends[:-1]] != self.newline).any():
                    self._learn_each(own, [w.decode() for w in part])
                    continue
                counts[1:] -= 1
                ids = np.delete(ids, ends[:-1])
            self._put(own, counts, ids)

    def _learn_each(self, keys: np.ndarray, texts: list[str]) -> None:
        found = self.whole(texts)
        self._put(keys, np.array([len(f) for f in found]), np.array([i for f in found for i in f], "<u4"))

    def _plain(self, texts: list[bytes]) -> np.ndarray:
        """Keys of marks and white space."""
        keys = 2 * self._places(texts)
        new = [i for i, k in enumerate(keys.tolist()) if self.count[k] < 0]
        if new:
            self._learn_each(keys[new], [texts[i].decode() for i in new])
        return keys

    # Texts.

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (None: of the empty one)."""
        out: list[bytes] = []
        for ids, ends in self.steps(texts):
            raw, at = ids.tobytes(), 0
            for e in (4 * ends).tolist():
                out.append(raw[at:e])
                at = e
        return out

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """How many ids each text has."""
        return np.concatenate([np.zeros(0, np.int64), *(np.diff(ends, prepend=0) for _, ends in self.steps(texts))])

    def steps(self, texts: list[str | None]):
        """All ids of some texts, and where each text's end; in bounded steps, for memory's sake."""
        step: list[str] = []
        size = 0
        for t in texts:
            t = t or ""
            if len(t) > _STEP and self.chunked:
                if step:
                    yield self._step(step)
                    step, size = [], 0
                parts = [self._step([p])[0] for p in _pieces(t)]
                yield np.concatenate(parts), np.array([sum(map(len, parts))])
                continue
            step.append(t)
            size += len(t)
            if size > _STEP:
                yield self._step(step)
                step, size = [], 0
        if step:
            yield self._step(step)

    def _step(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.chunked:
            return _joined([np.array(ids, "<u4") for ids in self.whole(texts)])
        parts = [t.encode() for t in texts]
        odd = self._odd(texts, parts)
        if not odd:
            return self._words(parts)
        for i in odd:
            parts[i] = b""
        ids, ends = self._words(parts)
        out = np.split(ids, ends[:-1])
        for i, x in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = np.array(x, "<u4")
        return _joined(out)

    def _odd(self, texts: list[str], parts: list[bytes]) -> list[int]:
        """Texts with special strings, or white space besides blanks and line ends: sought by their bytes first."""
        raw = b"\n".join([*parts, b""])
        data = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(_ODD_FIRST[data])
        first, second = data[at], data[np.minimum(at + 1, len(data) - 1)]
        odd = _ODD_BYTE[first]
        for a, b in _ODD_PAIRS:
            odd |= (first == a) & (second == b)
        found = [at[odd]]
        for special in self.special:
            if special in raw:
                found.append(np.array([m.start() for m in re.finditer(re.escape(special), raw)]))
        found = np.concatenate(found)
        if not len(found):
            return []
        stop = np.cumsum([len(p) + 1 for p in parts])
        return [i for i in np.unique(np.searchsorted(stop, found, "right")).tolist() if self.odd.search(texts[i])]

    def _words(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.kept or self.size > 100 * self.kept:
            self._thin()
        data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        stop = np.cumsum([len(p) + 1 for p in parts]) - 1
        begin = np.concatenate([[0], stop[:-1] + 1])
        inside = np.zeros(len(data) + 2, bool)
        np.logical_and(data != 32, data != 10, out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        n = len(start)
        upto = np.searchsorted(start, stop)  # words until each text's end
        own = np.diff(upto, prepend=0)
        # White space before each word.
        before = np.concatenate([[0], end[:-1]])[:n]
        some = own > 0
        before[(upto - own)[some]] = begin[some]
        run = start - before
        last = np.where(run > 0, data[start - 1], 0)
        spaced, line, more = last == 32, last == 10, run > 1
        marks = self._marks(data, start, end)
        mark, close = marks > 0, end - marks
        # Each distinct word once.
        for i in range(int(marks.max(initial=0))):
            inside[close[marks > i] + i + 1] = False
        distinct, codes = _distinct(data[inside[1:-1]], close - start)
        places = self._places(distinct)
        met = np.zeros(2 * len(distinct), bool)
        met[2 * codes.astype(np.int64) + spaced] = True
        met = np.flatnonzero(met)
        met = met[self.count[2 * places[met >> 1] + (met & 1)] < 0]
        for flag, prefix in ((0, b""), (1, b" ")):
            new = met[met & 1 == flag] >> 1
            if len(new):
                self._learn(2 * places[new] + flag, [distinct[i] for i in new.tolist()], prefix)
        # Marks and white space: what stands before a word's last blank, and at the end of a text.
        rest = np.where(some, end[np.maximum(upto, 1) - 1] if n else 0, begin)
        trailing = stop > rest
        spans = [*zip(before[more].tolist(), (start[more] - 1).tolist(), strict=True), *zip(rest[trailing].tolist(), stop[trailing].tolist(), strict=True)]
        several = np.flatnonzero(marks > 1)
        raw = data.tobytes() if spans else b""
        spans = [raw[a:b] for a, b in spans]
        many = marks[several]
        runs, of_run = _distinct(data[np.repeat(close[several] - (np.cumsum(many) - many), many) + np.arange(many.sum())], many)
        kinds = sorted(set(spans) | set(runs) | {b"\n"} | {bytes([c]) for c in np.unique(data[close[marks == 1]]).tolist()})
        plain = dict(zip(kinds, self._plain(kinds).tolist(), strict=True))
        spans = np.array([plain[s] for s in spans], np.int64)
        of_mark = np.zeros(256, np.int64)
        for k, v in plain.items():
            if len(k) == 1:
                of_mark[k[0]] = v
        # The keys in order.
        each = 1 + line + mark + more
        ends = np.cumsum(each)
        at = ends - each + np.repeat(np.cumsum(trailing) - trailing, own)
        ends = np.concatenate([[0], ends])[upto] + np.cumsum(trailing)
        keys = np.empty(int(ends[-1]), np.int64)
        keys[at[more]] = spans[: more.sum()]
        at += more
        keys[at[line]] = plain[b"\n"]
        at += line
        keys[at] = 2 * places[codes] + spaced if n else 0
        keys[at[mark] + 1] = of_mark[data[close[mark]]]
        keys[at[several] + 1] = np.array([plain[r] for r in runs], np.int64)[of_run]
        keys[ends[trailing] - 1] = spans[more.sum() :]
        many = self.count[keys]
        upto = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        ids = self.ids[np.repeat(self.start[keys] - upto[:-1], many) + np.arange(upto[-1])]
        return ids, upto[ends]

    @staticmethod
    def _marks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many marks at the end of each word are a pre-token of their own."""
        out = np.zeros(len(start), np.int64)
        left = np.flatnonzero(_MARK[data[end - 1]])
        for _ in range(_MARKS):
            out[left] += 1
            left = left[end[left] - out[left] > start[left]]
            left = left[_MARK[data[end[left] - out[left] - 1]]]
            if not len(left):
                break
        out[left] = 0
        some = np.flatnonzero(out)
        at = end[some] - out[some] - 1
        inner = at >= start[some]
        letter = (data[at - 1] == 0xC3) & _LETTER_C3[data[at]] & (at > start[some])
        out[some[~(inner & (_ALNUM[data[at]] | letter))]] = 0
        return out


def _distinct(data: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct strings of those that stand one behind the other in `data`, and which of them each is."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    found = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    found = pc.dictionary_encode(found, memory_pool=pa.system_memory_pool())
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*parts, np.zeros(0, "<u4")]), np.cumsum([len(p) for p in parts])


def _pieces(text: str):
    """A long text cut before single blanks between other characters, where pre-tokens end whatever stands around."""
    at = 0
    while at < len(text):
        cut = _CLEAN.search(text, at + _STEP)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, made once per process."""
    kept = common.cache("tokens")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
