"""Language ID by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length, the last one padded with zeros. For each window, filters of
several widths run over embedded bytes, the largest value of each filter over the window is kept, and a softmax layer
gives a chance to each language. A text's chances are those of its windows, weighted by their bytes. Embedding and filter
weights are multiplied out once after training, so that a filter costs one table row per byte.

The network is fitted on at most about `sample` labelled texts a language, and a few windows of each: these bound what
comes to the driver. It is applied to every byte of every text.

Defined cases: a text that is null or has no letter gets `und` and score 0; so does every text if nothing is labelled;
repeated rows each get a row; an empty table gives an empty result; a null doc_id is neither held out nor learned from;
columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of a Unicode letter category is in it; numerals that count as parts of words are no letters."""
    m = _WORD.search(text)
    return m is not None and (m[0].isalpha() or any(x[0].isalpha() for x in _WORD.finditer(text, m.end())))


@dataclass
class Network:
    languages: list[str]
    taps: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def chances(self, windows: np.ndarray) -> np.ndarray:
        """For each window (rows of bytes), the chance of each language."""
        index = windows.astype(np.intp)
        z = np.maximum(_pool(index, self.taps)[0] + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _pool(index: np.ndarray, taps: list[np.ndarray], where: bool = False):
    best, at = [], []
    for t in taps:
        n = index.shape[1] - len(t) + 1
        v = np.take(t[0], index[:, :n], axis=0)
        for j in range(1, len(t)):
            v += np.take(t[j], index[:, j : j + n], axis=0)
        best.append(v.max(axis=1))
        if where:
            at.append(v.argmax(axis=1))
    return np.concatenate(best, axis=1), at


def cut(data: bytes, window: int = WINDOW) -> np.ndarray:
    """The windows of a text's bytes; an empty text has one, of zeros."""
    n = max(1, -(-len(data) // window))
    out = np.zeros(n * window, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, window)


def train(texts: list[str], langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, dims: int = 8, seed: int = 0) -> Network:
    """Adam on the cross entropy of windows; `texts` are cut to one window each."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    x = np.concatenate([cut(t.encode()[:WINDOW]) for t in texts]).astype(np.intp)
    y = np.searchsorted(languages, langs)
    p = [rng.normal(0, 0.5, (256, dims))] + [rng.normal(0, 1 / np.sqrt(w * dims), (w, dims, FILTERS)) for w in WIDTHS]
    p += [np.zeros(FILTERS * len(WIDTHS)), rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages))]
    p = [a.astype(np.float32) for a in p]
    first, second, step, k = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0, len(WIDTHS)
    weight = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            bx, by = x[rows], y[rows]
            pooled, at = _pool(bx, [p[0] @ w for w in p[1 : k + 1]], where=True)
            pooled += p[k + 1]
            hidden = np.maximum(pooled, 0)
            z = hidden @ p[k + 2] + p[k + 3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = z / z.sum(axis=1, keepdims=True)
            dz[np.arange(len(by)), by] -= 1
            dz *= (weight[by] / len(by))[:, None]
            dh = (dz @ p[k + 2].T) * (pooled > 0)
            grads = [np.zeros_like(a) for a in p]
            grads[k + 1], grads[k + 2], grads[k + 3] = dh.sum(axis=0), hidden.T @ dz, dz.sum(axis=0)
            for f, w in enumerate(WIDTHS):
                d = dh[:, f * FILTERS : (f + 1) * FILTERS]
                for j in range(w):
                    b = np.take_along_axis(bx, at[f] + j, axis=1)  # the byte under tap j where each filter was largest
                    grads[f + 1][j] = np.einsum("nfd,nf->df", p[0][b], d)
                    np.add.at(grads[0], b, d[:, :, None] * p[f + 1][j].T[None])
            step += 1
            for a, g, m, v in zip(p, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return Network(languages, [(p[0] @ w).astype(np.float32) for w in p[1 : k + 1]], p[k + 1], p[k + 2], p[k + 3])


def fit(docs: DataFrame, sample: int = 1500, windows: int = 3, **how) -> Network | None:
    """Train on labelled texts that are not held out, about `sample` of each language; None if there are none."""
    rows = common.columns(docs, doc_id="long", text="string", lang="string")
    rows = rows.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (draw < int(min(1.0, sample / n) * (1 << 30))))
    place = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1 for i in range(windows)]
    parts = rows.filter(keep).select("doc_id", "lang", F.posexplode(F.array(*(F.substring(F.col("text"), at, F.lit(WINDOW)) for at in place))).alias("i", "part"))
    got = sorted((r.doc_id, r.i, r.lang, r.part) for r in parts.collect())
    got = [g for g in got if has_letter(g[3])]
    return train([g[3] for g in got], [g[2] for g in got], **how) if got else None


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _predictor(net: Network | None):
    def predict(batches):
        common.cache("language")
        for rows in common.slices(batches, 1_000_000):
            texts = rows.column("text").to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            for group in _groups([j for j, t in enumerate(texts) if t and net and has_letter(t)], texts):
                data = [texts[j].encode() for j in group]
                parts = [cut(d) for d in data]
                all_ = np.concatenate(parts)
                chance = np.concatenate([net.chances(all_[k : k + 512]) for k in range(0, len(all_), 512)])
                end = 0
                for j, d, p in zip(group, data, parts, strict=True):
                    weight = np.full(len(p), WINDOW, np.float64)
                    weight[-1] = len(d) - WINDOW * (len(p) - 1)
                    mean = weight @ chance[end : end + len(p)] / weight.sum()
                    end += len(p)
                    best = int(mean.argmax())
                    lang[j], score[j] = net.languages[best], float(min(1.0, mean[best]))
            yield pa.record_batch([rows.column("doc_id"), rows.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def _groups(rows: list[int], texts: list, most: int = 1_000_000):
    """Rows in groups of about `most` characters."""
    group, size = [], 0
    for j in rows:
        group.append(j)
        size += len(texts[j])
        if size > most:
            yield group
            group, size = [], 0
    if group:
        yield group


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. Only doc_id and text are read."""
    rows = common.columns(docs, doc_id="long", text="string").withColumn("held_out", held_out("doc_id"))
    return rows.mapInArrow(_predictor(net), RESULT)


def filter_known(docs: DataFrame, net: Network | None, least: float = 0.5) -> DataFrame:
    """The documents with a language, by a score of `least` or more; whole rows as they were."""
    kept = common.packed(docs).withColumn("score", _score_udf(net)(F.col("row.text").cast("string")))
    return kept.filter(F.col("score") >= least).select("row.*")


def _score_udf(net: Network | None):
    run = _predictor(net)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        n = len(text)
        rows = pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(text, pa.string(), from_pandas=True)], ["doc_id", "held_out", "text"])
        return pd.concat([b.column("score").to_pandas() for b in run([rows])], ignore_index=True) if n else pd.Series([], dtype=float)

    return score
