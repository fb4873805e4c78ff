"""URL filter: rules where one fits, and gradient-boosted trees on lexical features for the rest.

The trees are oblivious ones (a level asks one question of all rows), grown on histograms that DataFrame aggregates
make; only a histogram, of at most nodes x features x bins rows, comes to the driver. A fitted model is a column
expression of built-in functions, so that judging URLs is a projection in one pass.

Labels come from the rules themselves, or from a column of the caller's. They are fitted on a sample of labelled rows
of about `sample` rows, chosen by a hash of the row; every row is judged.

Defined cases: a null URL, or one without "://", has an empty host and path, fits no rule and is judged by its features;
without labelled rows of both kinds the verdict is that of the labels there are, or allow; repeated rows each get a row;
an empty table gives an empty result; columns besides page_id and url are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BINS = 16
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters", "fragment", "suffix", "domain")


@dataclass(frozen=True)
class Rule:
    """`text` is host/path: it fits the host and its subdomains where the URL's path starts with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if "/" in self.text else ""

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


@dataclass
class Model:
    """Sum of trees; each has its questions (feature, threshold) and a value for each combination of answers."""

    base: float = 0.0
    trees: list[tuple[list[tuple[int, float]], list[float]]] = field(default_factory=list)
    edges: list[list[float]] = field(default_factory=list)
    suffixes: dict[str, float] = field(default_factory=dict)
    domains: dict[str, float] = field(default_factory=dict)

    def margin(self, features: list[Column]) -> Column:
        return _margin(self.base, self.trees, features)


def _margin(base: float, trees: list, features: list[Column]) -> Column:
    out = F.lit(base)
    for questions, values in trees:
        out = out + F.element_at(F.array(*map(F.lit, values)), _leaf(questions, features) + 1)
    return out


def _leaf(questions: list, features: list[Column]) -> Column:
    place = F.lit(0)
    for i, (f, threshold) in enumerate(questions):
        place = place + (features[f] > threshold).cast("int") * (1 << i)
    return place


def split_url(df: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = F.expr("if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')")
    df = df.withColumn("_rest", F.coalesce(rest, F.lit("")))
    df = df.withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    df = df.withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), "^[^?#]*", 0))
    return df.withColumn("host", F.translate("_host", upper, lower)).drop("_rest", "_host")


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, char, ""))).cast("double")


def _statistic(key: Column, known: dict[str, float]) -> Column:
    if not known:
        return F.lit(0.0)
    pairs = [F.lit(x) for kv in sorted(known.items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(0.0))


def features(model: Model) -> list[Column]:
    """The lexical features, as expressions over url, host and path. Shannon entropy is in nats over characters."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.length(url).cast("double")
    k_log_k = F.aggregate(
        F.array_distinct(F.split(url, "")), F.lit(0.0),
        lambda total, c: total + F.when(c == "", 0.0).otherwise((n - F.length(F.replace(url, c, F.lit("")))) * F.log(F.greatest(n - F.length(F.replace(url, c, F.lit(""))), F.lit(1.0)))),
    )
    size = F.greatest(n, F.lit(1.0))
    return [
        n, F.length(host).cast("double"), F.length(path).cast("double"), _count(path, "/"), _count(host, "."),
        _count(url, "0123456789") / size, _count(url, "-"), F.log(size) - k_log_k / size,
        _count(url, "=&"), _count(url, "#"),
        _statistic(F.substring_index(host, ".", -1), model.suffixes), _statistic(F.substring_index(host, ".", -2), model.domains),
    ]


def _statistics(labelled: DataFrame, depth: int, most: int) -> dict[str, float]:
    """Smoothed log odds of block of the `most` commonest host endings of so many labels: a table of fixed size."""
    key = F.substring_index("host", ".", -depth).alias("key")
    counts = labelled.groupBy(key).agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    rows = counts.orderBy(F.desc("n"), "key").limit(most).collect()
    return {r.key: round(math.log((r.bad + 1) / (r.n - r.bad + 1)), 6) for r in rows}


def fit(labelled: DataFrame, trees: int = 16, depth: int = 3, rate: float = 0.3, sample: int = 20_000, suffixes: int = 256, ridge: float = 1.0) -> Model:
    """Fit on rows with page_id, url, host, path and label (1: block)."""
    totals = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")).first()
    if not totals.n:
        return Model(base=-1.0)
    model = Model(base=round(math.log((totals.bad + 0.5) / (totals.n - totals.bad + 0.5)), 6))
    if totals.bad in (0, totals.n):
        return model
    part = min(1.0, sample / totals.n)
    chosen = labelled.filter(F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    model.suffixes, model.domains = _statistics(chosen, 1, suffixes), _statistics(chosen, 2, suffixes)
    values = common.stored(chosen.select(*(f.alias(n) for f, n in zip(features(model), FEATURES, strict=True)), "label"), "url-sample")
    steps = [i / BINS for i in range(1, BINS)]
    cuts = values.agg(*(F.percentile_approx(n, steps, 10_000).alias(n) for n in FEATURES)).first()
    if cuts[0] is None:
        return model
    model.edges = [sorted(set(cuts[n])) for n in FEATURES]
    bins = [sum(((F.col(n) > x).cast("int") for x in e), F.lit(0)).alias(n) for n, e in zip(FEATURES, model.edges, strict=True)]
    rows = values.select(*bins, "label").groupBy(*FEATURES).agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    rows = common.stored(rows.coalesce(4).withColumn("margin", F.lit(model.base)), "url-bins")
    places = [F.col(n) for n in FEATURES]
    grown: list = []
    for _ in range(trees):
        if grown:
            rows = common.stored(rows.withColumn("margin", _margin(0.0, grown[-1:], places) + F.col("margin")), "url-bins")
        p = 1 / (1 + F.exp(-F.col("margin")))
        at = rows.select(F.array(*places).alias("bins"), *places, (F.col("bad") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        questions: list = []
        for level in range(depth):
            cells = at.select(_leaf(questions, places).alias("node"), F.posexplode("bins").alias("feature", "bin"), "g", "h")
            cells = cells.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            best = _best(cells, 1 << level, model.edges, ridge)
            if best is None:
                break
            questions.append(best[:2])
            sums = best[2]
        if not questions:
            break
        grown.append((questions, [round(rate * g / (h + ridge), 6) for g, h in sums]))
    # On the training rows, a bin above t means a value above edge t.
    model.trees = [([(f, model.edges[f][t]) for f, t in questions], values) for questions, values in grown]
    return model


def _best(cells: list, nodes: int, edges: list[list[float]], ridge: float):
    """The question that gains most over all nodes, and the leaves' sums of gradients and curvatures after it."""
    grid = [[[[0.0, 0.0] for _ in range(len(e) + 1)] for e in edges] for _ in range(nodes)]
    for c in cells:
        grid[c.node][c.feature][c.bin] = [c.g, c.h]
    found = None
    score = lambda g, h: g * g / (h + ridge)
    for f, e in enumerate(edges):
        whole = [[sum(x[i] for x in grid[n][f]) for i in (0, 1)] for n in range(nodes)]
        low = [[0.0, 0.0] for _ in range(nodes)]
        for t in range(len(e)):
            low = [[low[n][i] + grid[n][f][t][i] for i in (0, 1)] for n in range(nodes)]
            high = [[whole[n][i] - low[n][i] for i in (0, 1)] for n in range(nodes)]
            gain = round(sum(score(*low[n]) + score(*high[n]) - score(*whole[n]) for n in range(nodes)), 6)
            if gain > 1e-4 and (found is None or gain > found[0]):
                found = (gain, f, t, low + high)
    return found and found[1:]


def judge(pages: DataFrame, rules: list[Rule], model: Model | None = None, **fitting) -> DataFrame:
    """page_id, host, path, rule, verdict, score (chance of block) of every row; the longest fitting rule wins.

    Without a model, one is fitted on the rows that a rule labels.
    """
    rows = split_url(common.columns(pages, page_id="long", url="string"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    rows = rows.withColumn("rule", rule).withColumn("_given", verdict)
    if model is None:
        model = fit(rows.filter("_given IS NOT NULL").withColumn("label", (F.col("_given") == "block").cast("long")), **fitting)
    score = 1 / (1 + F.exp(-model.margin(features(model))))
    return rows.withColumn("score", score).select(
        "page_id", "host", "path", "rule", F.coalesce("_given", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score"
    )
