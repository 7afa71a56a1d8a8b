"""URL filters: gradient-boosted trees on lexical features, beside host and path rules.

Features of an url: its length, labels of the host, depth of the path, share of digits, entropy of its
characters, number of parameters, and suffix statistics (how often host suffixes of one to three labels,
the path's extension and its first step were blocked in training, smoothed).  The trees are trained from labelled urls:
those that a rule decides.  The rule of longest text that fits decides a page; the trees decide the rest.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by
the trees on an empty text; suffixes that the sample lacks count as its mean; an empty table gives an empty result; without labelled urls the trees are a
constant (allow); repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled urls at most (in the mean) that the trees are trained on; trees, their depth, bins of a feature.
SAMPLE, TREES, DEPTH, BINS = 20_000, 40, 3, 32
RATE, RIDGE, SUFFIXES = 0.3, 1.0, 5
#: Fixed values: (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
_URL = re.compile(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?(#.*)?", re.DOTALL)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url):
    """(host, path) columns of an url column."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule(host, path, rules=RULES):
    """The longest rule that fits, as (rule, verdict) columns; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        top, _, rest = text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _byte_shares(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of ASCII digits, and entropy of the bytes, of each url."""
    raws = [u.encode() for u in urls]
    flat = np.frombuffer(b"".join(raws), np.uint8)
    owner = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
    count = np.bincount(owner * 256 + flat, minlength=256 * len(raws)).reshape(len(raws), 256)
    share = count / np.maximum(1, count.sum(axis=1, keepdims=True))
    return count[:, 48:58].sum(axis=1), -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=1)


def _numbers(urls: list[str]) -> tuple[np.ndarray, list[tuple[str, ...]]]:
    """Numeric features, and the suffixes (host's last label, last two, last three, path's extension, first step)."""
    out = np.zeros((len(urls), 9))
    suffixes = []
    for i, url in enumerate(urls):
        host, path, query, anchor = _URL.match(url.partition("://")[2]).groups()
        labels = host.lower().split(".")
        out[i] = len(url), len(host), len(labels), sum(map(bool, path.split("/"))), 0, 0, sum(map(bool, (query or "").split("&"))), anchor is not None, len(path)
        last = path.rsplit("/", 1)[-1]
        suffixes.append((labels[-1], ".".join(labels[-2:]), ".".join(labels[-3:]), last.rpartition(".")[2] if "." in last else "", path[1:].partition("/")[0]))
    for begin in range(0, len(urls), 4096):  # 256 counters an url
        digits, entropy = _byte_shares(urls[begin : begin + 4096])
        out[begin : begin + 4096, 4] = digits / np.maximum(1, out[begin : begin + 4096, 0])
        out[begin : begin + 4096, 5] = entropy
    return out, suffixes


@dataclass
class Boosted:
    bias: float
    trees: list[list[tuple[int, float, float]]]
    suffixes: list[dict[str, float]]
    default: float

    def features(self, urls: list[str]) -> np.ndarray:
        numbers, suffixes = _numbers(urls)
        known = [[table.get(s, self.default) for s, table in zip(row, self.suffixes)] for row in suffixes]
        return np.hstack([numbers, np.array(known, np.float64).reshape(len(urls), SUFFIXES)])

    def score(self, urls: list[str]) -> np.ndarray:
        """Probability of block."""
        x = self.features(urls)
        out = np.full(len(urls), self.bias)
        for nodes in self.trees:
            out += _walk(nodes, x)
        return 1 / (1 + np.exp(-out))


def _walk(nodes, x: np.ndarray) -> np.ndarray:
    """A complete tree as a heap of (feature, threshold, value); leaves have feature -1."""
    at = np.zeros(len(x), np.int64)
    feature = np.array([n[0] for n in nodes])
    limit, value = np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes])
    rows = np.arange(len(x))
    for _ in range(DEPTH):
        inner = feature[at] >= 0
        right = x[rows, np.maximum(feature[at], 0)] > limit[at]
        at = np.where(inner, 2 * at + 1 + right, at)
    return value[at]


def train(urls: list[str], blocked: np.ndarray, weights: np.ndarray) -> Boosted:
    """Boosted trees of second-order gain over histogram bins."""
    total = max(weights.sum(), 1.0)
    default = float((weights * blocked).sum() / total) if len(urls) else 0.0
    if not len(urls) or default in (0.0, 1.0):
        return Boosted(6.0 * (default or -1.0), [], [{}] * SUFFIXES, default)
    _, suffixes = _numbers(urls)
    tables: list[dict[str, float]] = []
    for j in range(SUFFIXES):
        sums: dict[str, list[float]] = {}
        for row, y, w in zip(suffixes, blocked, weights):
            s = sums.setdefault(row[j], [0.0, 0.0])
            s[0] += w * y
            s[1] += w
        tables.append({k: (a + 5 * default) / (n + 5) for k, (a, n) in sums.items()})  # as many as there are urls in the sample at most
    model = Boosted(float(np.log(default / (1 - default))), [], tables, default)
    x = model.features(urls)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(x), model.bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weights * (p - blocked), weights * p * (1 - p)
        nodes: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (DEPTH + 1) - 1)
        groups = {0: np.arange(len(x))}
        for at in range(len(nodes)):
            rows = groups.pop(at, None)
            if rows is None:
                continue
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, -1, 0)
            if at < 2**DEPTH - 1:
                for j, c in enumerate(cuts):
                    gl = np.cumsum(np.bincount(bins[rows, j], grad[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(bins[rows, j], hess[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), j, int(gain.argmax()))
            if best[1] < 0:
                nodes[at] = (-1, 0.0, float(-RATE * g / (h + RIDGE)))
                continue
            _, j, k = best
            nodes[at] = (j, float(cuts[j][k]), 0.0)
            left = bins[rows, j] <= k
            groups[2 * at + 1], groups[2 * at + 2] = rows[left], rows[~left]
        model.trees.append(nodes)
        margin += _walk(nodes, x)
    return model


def learn(pages: DataFrame, rules=RULES, limit: int = SAMPLE) -> Boosted:
    """Trees from about ``limit`` of the urls that the rules decide, picked by a hash of the url; equal
    urls are counted before they are gathered."""
    host, path = parts(F.col("url"))
    labelled = pages.select("url", rule(host, path, rules)[1].alias("says")).where("says is not null")
    total = labelled.count()
    if total > limit:
        labelled = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int((1 << 20) * limit / total))
    rows = sorted(labelled.groupBy("url", "says").count().collect())
    return train([r.url for r in rows], np.array([float(r.says == "block") for r in rows]), np.array([float(r["count"]) for r in rows]))


def judge(pages: DataFrame, model: Boosted, rules=RULES, threshold: float = 0.5, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, score): the rule's verdict, else that of the trees."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.pandas_udf("double")
    def blocked(urls: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(urls.fillna("").tolist()))

    host, path = parts(F.col("url"))
    rows = pages.select(key, "url", host.alias("host"), path.alias("path")).withColumn("score", blocked("url"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    return rows.select(key, "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
