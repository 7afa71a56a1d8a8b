"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text.

Folding lower-cases, maps homoglyphs to Latin letters and, inside words, digits and signs that stand for
letters (1d10t, $cum); everything that is no letter becomes a space.  Lexicon entries are whole words or
beginnings of words, each with a weight; a hit inside an exception phrase does not count.  Entries and
weights (log odds, of texts that hold an entry and of its occurrences, the lesser of both) are learned from
a bounded sample of labelled rows, beside a small seed.  The sum of
weights, and that sum normalised by the length of the text, go through a logistic curve fitted on the
same sample.

Edge cases: null and empty texts hit nothing and score as a text without hits; texts without any letter
too; repeated rows score alike; an empty table gives an empty result; without labelled rows the seed
lexicon and a fixed curve hold; extra columns are ignored by ``score`` and kept by ``remove``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common

#: Look-alikes of Latin letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ρ": "p", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Words of abuse to begin with, and phrases in which such words are harmless.
SEED = ("disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless", "clown")
EXCEPTIONS = ("clown fish", "class clown", "trash bin", "trash can", "trash bag", "idiot proof", "pond scum")
#: Labelled rows at most that the lexicon and the curve are learned from.
SAMPLE = 6_000
#: Chance at which some gram of all would be in so many texts, and in toxic ones only, without bearing on it.
CHANCE = 1e-2
SEED_WEIGHT, LEAST_WEIGHT, MOST_ENTRIES = 3.0, 2.0, 5_000
PREFIXES = range(4, 9)

_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])|(?<!\S)[013457@$]+(?=[^\W\d_])")
_SUB = str.maketrans(SUBSTITUTES)
_CLEAN = {c: " " for c in range(128) if not chr(c).isalpha()} | {c: " " for c in (*range(0x80, 0xC0), 0xD7, 0xF7, *range(0x2000, 0x2070), *range(0x3000, 0x3004))} | {0x2581: " "}
_FOLD = _CLEAN | {ord(a): b for a, b in HOMOGLYPHS.items()} | {c: chr(c - 0xFF41 + 97) for c in range(0xFF41, 0xFF5B)}
_LETTERS = {k: v for k, v in _FOLD.items() if v != " "}
_MARKS = re.compile("[013457@$!]")


def fold(text: str | None) -> str:
    """The folded text with one space before and after it."""
    text = (text or "").lower()
    plain = text.isascii()
    if not plain:
        text = text.translate(_LETTERS)
    if _MARKS.search(text):
        text = _INSIDE.sub(lambda m: m[0].translate(_SUB), text)
    return f" {text.translate(_CLEAN if plain else _FOLD)} "


@dataclass
class Lexicon:
    """``entries``: (" word " or " beginning", weight).  ``curve``: bias and the factors of log(1 + sum)
    and of log(1 + sum per 1,000 characters)."""

    entries: list[tuple[str, float]]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 2.5, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for entry, weight in self.entries:
                found.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                found.add_word(f" {phrase} ", (len(phrase) + 2, None))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        hits, free = [], []
        for end, (n, weight) in self.automaton().iter(folded) if len(self.automaton()) else ():
            if weight is None:
                free.append((end - n, end))
            else:
                hits.append((end - n, end, weight))
        free.sort()
        begins, ends = [a for a, _ in free], list(accumulate((b for _, b in free), max))
        total = 0.0
        for begin, end, weight in hits:  # inside an exception if one that begins before it reaches on to its end
            k = bisect_right(begins, begin)
            if not k or ends[k - 1] < end:
                total += weight
        return math.log1p(total), math.log1p(1000 * total / (len(folded) + 200))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        bias, x, y = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + x * a + y * b))))


def _grams(folded: str) -> Counter:
    """How often each word, and each beginning of one, occurs; under the empty text the number of words."""
    words = folded.split()
    out = Counter({"": len(words)})
    for w, n in Counter(w for w in words if len(w) > 2).items():
        out[f" {w} "] += n
        for k in PREFIXES:
            if k < len(w):
                out[f" {w[:k]}"] += n
    return out


def learn(docs: DataFrame, labels: DataFrame, train, limit: int = SAMPLE) -> Lexicon:
    """A lexicon from about ``limit`` labelled rows with ``train`` true.  Repeated texts are counted once."""
    sample = _common.written(_common.labelled_sample(docs, labels, "toxic", train, limit), "toxicity")
    once = sample.select("text", (F.col("label") == 1).alias("bad")).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, times = (Counter(), Counter()), (Counter(), Counter())
        for batch in batches:
            for text, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _grams(fold(text))
                texts[bad].update(found.keys())
                times[bad].update(found)
        for part in _common.chunked([*texts[1], *(g for g in texts[0] if g not in texts[1])], 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[g] for g in part], pa.int64()) for c in (texts[1], texts[0], times[1], times[0]))], ["gram", "pos", "neg", "pos_times", "neg_times"])

    columns = ["pos", "neg", "pos_times", "neg_times"]
    counted = once.mapInArrow(count, "gram string, pos long, neg long, pos_times long, neg_times long").groupBy("gram").agg(*[F.sum(c).alias(c) for c in columns])
    counted = _common.written(counted, "grams")
    grams, all_ = counted.count(), counted.where("gram = ''").first()
    entries = {f" {w} ": SEED_WEIGHT for w in SEED}
    if all_ is not None and all_.pos and all_.neg:
        odds = lambda p, n, of_p, of_n: F.log((F.col(p) + 0.5) / (of_p + 1.0)) - F.log((F.col(n) + 0.5) / (of_n + 1.0))
        weight = F.least(odds("pos", "neg", all_.pos, all_.neg), odds("pos_times", "neg_times", all_.pos_times, all_.neg_times))
        # in so many toxic texts that chance hardly makes it with any of all grams
        least = max(math.ceil(math.log(CHANCE / grams) / math.log(all_.pos / (all_.pos + all_.neg))), all_.pos // 60)
        ranked = counted.where((F.col("gram") != "") & (F.col("pos") >= least)).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
        rows = ranked.orderBy(F.desc("pos"), F.length("gram"), "gram").limit(4 * MOST_ENTRIES).collect()
        taken: set[str] = set()
        for r in rows:  # a beginning stands for all that begin with it
            bare = r.gram.rstrip()
            if len(taken) < MOST_ENTRIES and not any(bare[:k] in taken for k in range(4, len(bare) + 1)):
                entries[r.gram] = r.weight
                if not r.gram.endswith(" "):
                    taken.add(bare)
        entries = {e: w for e, w in entries.items() if not e.endswith(" ") or not any(e[:k] in taken for k in range(4, len(e)))}
    lexicon = Lexicon(sorted(entries.items()))

    def measure(batches):
        for batch in batches:
            found = [lexicon.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), batch.column(1)], ["a", "b", "label"])

    if all_ is not None and all_.pos and all_.neg:
        rows = sample.select("text", "label").mapInArrow(measure, "a double, b double, label int").collect()
        x = np.array([(1.0, r.a, r.b) for r in rows])
        lexicon.curve = _logistic(x, np.array([float(r.label == 1) for r in rows]))
    _common.discard(sample, counted)
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> tuple[float, float, float]:
    """Newton's method, with a small ridge so that separable data give finite factors."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row's whole ``text``."""
    picked = docs.select(key, "text")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # MOST_ENTRIES bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, 1_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.score(t) for t in batch.column(1).to_pylist()], pa.float64())], [key, "score"])

    return picked.mapInArrow(run, f"{key} {picked.schema[key].dataType.simpleString()}, score double")


def remove(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows that score below ``threshold``, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index("text")

    def run(batches):
        for batch in _common.slices(batches, 1_000_000):
            yield batch.filter(pa.array([shared.value.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
