"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for urls that no rule fits.

The trees are grown from labelled urls by histogram splits on the logistic loss.  Features: lengths, depth, digit
ratio, entropy, counts of parameters and signs, and statistics of the host's suffixes (how often labelled urls of
the suffix were blocked, shrunk towards the overall rate).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, least

#: A url's host and path.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        """From text such as ``example.org/es/``."""
        host, _, path = text.partition("/")
        return cls(verdict, host, "/" + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for a null url or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, PARTS, 1)), F.regexp_extract(url, PARTS, 2)


def fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The index of the longest rule that fits, or null.  A rule fits its host and all subdomains where the path starts with its own."""
    found = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: len(rules[i].text)):
        r = rules[i]
        here = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(here, F.lit(i)).otherwise(found)
    return found


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(host: str) -> list[str]:
    """The host's last label, last two and last three."""
    labels = host.split(".")
    return [".".join(labels[-k:]) for k in (1, 2, 3)]


def lexical(url: str, host: str, path: str, rates: dict[str, float], rate: float) -> list[float]:
    query = url.partition("?")[2].partition("#")[0]
    letters = len(url) or 1
    return [
        len(url), len(host), len(path), len(query), path.count("/"), host.count("."), host.count("-"), sum(map(str.isdigit, url)) / letters, sum(map(str.isdigit, host)), sum(map(str.isdigit, path)),
        entropy(host), entropy(path), query.count("&") + bool(query), "#" in url, "%" in url, url.startswith("https"), path.endswith("/"), "." in path.rpartition("/")[2], max(map(len, path.split("/"))), *(rates.get(s, rate) for s in suffixes(host)),
    ]


#: Folds of the suffix rates that trees are trained on.
FOLDS = 5


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return np.array(self.value)[at]
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= cut[node], left[node], right[node])


@dataclass
class Boosted:
    """Trees over a bias, with the suffixes' block rates that features need."""

    bias: float
    trees: list[Tree]
    rates: dict[str, float]
    rate: float

    def block_probability(self, urls: list[tuple[str, str, str]]) -> np.ndarray:
        if not urls or not self.trees:
            return np.full(len(urls), 1 / (1 + math.exp(-self.bias)))
        x = np.array([lexical(*u, self.rates, self.rate) for u in urls], float)
        return 1 / (1 + np.exp(-(self.bias + sum((t.predict(x) for t in self.trees), np.zeros(len(x))))))


def grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: int, ridge: float) -> Tree:
    """One tree on gradients g and curvatures h; bins are x by edges."""
    tree = Tree()

    def node(rows: np.ndarray, level: int) -> int:
        at = len(tree.feature)
        for values, empty in ((tree.feature, -1), (tree.cut, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, 0.0)):
            values.append(empty)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        tree.value[at] = float(-rate * total_g / (total_h + ridge))
        best = (1e-9, -1, -1)
        if level < depth and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                size = len(edges[f]) + 1
                b = bins[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
                if not len(gl):
                    continue
                gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] >= 0:
            _, f, k = best
            tree.feature[at], tree.cut[at] = f, float(edges[f][k])
            low = bins[rows, f] <= k
            tree.left[at] = node(rows[low], level + 1)
            tree.right[at] = node(rows[~low], level + 1)
        return at

    node(np.arange(len(x)), 0)
    return tree


def train(urls: list[tuple[str, str, str]], blocked: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, least: int = 5, ridge: float = 1.0, shrink: float = 20.0) -> Boosted:
    """From (url, host, path) and whether each is blocked; the rate alone with one label or none, and where trees do not help on held-out urls."""
    blocked = np.asarray(blocked, float)
    n, ones = len(urls), float(blocked.sum())
    share = (ones + 0.5) / (n + 1)
    plain = Boosted(math.log(share / (1 - share)), [], {}, share)
    if not 0 < ones < n:
        return plain
    # Every third url (they come in the order of a hash) says how many trees help: none, where the features tell nothing.
    test = np.arange(n) % 3 == 2
    best, loss = 0, None
    if test.any() and 0 < blocked[~test].sum() < (~test).sum():
        learn = [u for u, t in zip(urls, test) if not t]
        model = _boosted(learn, blocked[~test], trees, depth, rate, least, ridge, shrink)
        x = np.array([lexical(*u, model.rates, model.rate) for u, t in zip(urls, test) if t], float)
        y, score = blocked[test], np.full(int(test.sum()), model.bias)
        for k in range(len(model.trees) + 1):
            if k:
                score = score + model.trees[k - 1].predict(x)
            now = float(np.mean(np.logaddexp(0, score) - y * score))
            if loss is None or now < loss - 1e-4:
                best, loss = k, now
    return _boosted(urls, blocked, best, depth, rate, least, ridge, shrink) if best else plain


def _boosted(urls: list[tuple[str, str, str]], blocked: np.ndarray, trees: int, depth: int, rate: float, least: int, ridge: float, shrink: float) -> Boosted:
    n, share = len(urls), (float(blocked.sum()) + 0.5) / (len(urls) + 1)
    fold = np.arange(n) % FOLDS
    seen, bad = ([Counter() for _ in range(FOLDS)] for _ in range(2))
    for (_, host, _), y, k in zip(urls, blocked, fold):
        for s in suffixes(host):
            seen[k][s] += 1
            bad[k][s] += int(y)
    every, ones = sum(seen, Counter()), sum(bad, Counter())

    def rates_of(c: Counter, b: Counter) -> dict[str, float]:
        return {s: (b[s] + shrink * share) / (m + shrink) for s, m in c.items() if m >= 5}

    rates = rates_of(every, ones)
    # A row's own label is in none of the rates that it is trained on: each fold takes those of the other folds.
    others = [rates_of(Counter({s: m - seen[k][s] for s, m in every.items()}), Counter({s: ones[s] - bad[k][s] for s in every})) for k in range(FOLDS)]
    model = Boosted(math.log(share / (1 - share)), [], rates, share)
    x = np.array([lexical(*u, others[k], share) for u, k in zip(urls, fold)], float)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    score = np.full(n, model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, bins, edges, p - blocked, p * (1 - p), depth, rate, least, ridge)
        model.trees.append(tree)
        score += tree.predict(x)
    return model


def split(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    host, path = parts(F.col(url_col).cast("string"))
    return pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", most: int = 20_000, **options) -> Boosted:
    """A model from labelled urls (label true or 1: blocked; null labels are left out).

    The sample is bounded: the ``most`` different urls with the least hashes, ties by url.  A url with both labels counts as blocked.
    An empty table, or one label alone, gives the rate without trees.  A very long url counts whole.
    """
    host, path = parts(F.col(url_col).cast("string"))
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"), F.col(label_col).cast("int").alias("y"))
    rows = rows.groupBy("url", "host", "path").agg(F.max("y").alias("y")).withColumn("r", F.xxhash64("url"))
    rows = least(rows, "r", most, "url").orderBy("r", "url").collect()
    return train([(r.url, r.host, r.path) for r in rows], np.array([r.y for r in rows], float), **options)


def judged(pages: DataFrame, rules: list[Rule], model: Boosted, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) for every row: the longest fitting rule's verdict, else the model's.

    Null urls and urls without ``://`` have an empty host and path and go to the model.  Of rules of one length the later wins;
    repeated rows each get a row; a very long url counts whole; an empty table gives none.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.block_probability(list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "p_block"])

    rows = split(pages, id_col, url_col)
    kind = rows.schema["page_id"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"page_id {kind}, url string, host string, path string, p_block double")
    found = fitting(F.col("host"), F.col("path"), rules)
    pick = lambda values: F.when(found.isNotNull(), F.element_at(F.array(*map(F.lit, values)), found + 1)) if values else F.lit(None).cast("string")
    return rows.select(
        "page_id", "host", "path", pick([r.text for r in rules]).alias("rule"),
        F.coalesce(pick([r.verdict for r in rules]), F.when(F.col("p_block") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "p_block",
    )
