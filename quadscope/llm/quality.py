"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its words (ASCII letters lower-cased) and the runs of three bytes inside them, both
hashed into a fixed number of terms, beside pairs of neighbouring character classes (letters by case,
digits, white space, each ASCII sign, bytes beyond ASCII) and repeated neighbouring words.  Each kind is
weighted by inverse document frequency and scaled to a share of its own.  A bounded sample of labelled
rows gives the term weights, the latent space (truncated singular value decomposition) and the labelled
vectors; these are broadcast, and every document's cosine products with all of them are computed in
blocks, exactly.  The nearest ``K`` vote with weights that grow with similarity; of neighbours that are
equally near to ``1 / SCALE`` the first ones of the sample, which is sorted, vote.

Edge cases: null and empty texts have no terms; they, and every text when no row is labelled, score the
share of label 1 in the sample (1.0 without a sample); repeated rows score alike; an empty table gives an
empty result; extra columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common

#: Labelled rows at most that are broadcast; dimensions of the latent space; voting neighbours.
SAMPLE, DIMENSIONS, K = 4_000, 64, 15
#: Similarities are compared as multiples of 1 / SCALE, so that the order of sums does not matter.
SCALE = 1_000_000
#: Documents of which the products with the labelled vectors are held at a time.
BLOCK = 512
#: Texts, and their bytes, whose term counts are held at a time.
ROWS, BYTES = 512, 1_000_000
#: Terms that words, and runs of three bytes, are hashed into; the shares of words, runs, pairs of classes and
#: repetitions.  Words and runs count as directions, the others (share 1) by their frequency too.
WORDS, RUNS = 2_048, 1_024
SHARES = (0.7, 0.7, 1.0, 1.0)


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    for c in range(256):
        if c >= 0x80:
            table[c] = 5
        elif chr(c).islower():
            table[c] = 0
        elif chr(c).isupper():
            table[c] = 1
        elif chr(c).isdigit():
            table[c] = 2
        elif c == 10:
            table[c] = 3
        elif c in signs:
            table[c] = 6 + signs.index(c)
        else:
            table[c] = 4
    return table


_CLASS = _classes()
_N = int(_CLASS.max()) + 1
PAIRS = _N * _N
TERMS = WORDS + RUNS + PAIRS + 2
_KINDS = (slice(0, WORDS), slice(WORDS, WORDS + RUNS), slice(WORDS + RUNS, TERMS - 2), slice(TERMS - 2, TERMS))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def counts(texts: list[bytes]) -> np.ndarray:
    """Term counts (texts x TERMS)."""
    out = np.zeros((len(texts), TERMS), np.float32)
    if not texts:
        return out
    raw = np.frombuffer(b" \0".join([*texts, b""]), np.uint8)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])

    def add(kind: slice, owner: np.ndarray, term: np.ndarray) -> None:
        width = kind.stop - kind.start
        out[:, kind] = np.bincount(owner * width + term, minlength=len(texts) * width).reshape(len(texts), width)

    cls = _CLASS[raw]
    inside = (raw[:-1] != 0) & (raw[1:] != 0)
    add(_KINDS[2], doc[:-1][inside], cls[:-1][inside] * _N + cls[1:][inside])
    low = _LOWER[raw].astype(np.uint64)
    letter = raw > 32
    begin = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
    if not len(begin):
        return out
    run = np.flatnonzero(letter[:-2] & letter[1:-1] & letter[2:])
    with np.errstate(over="ignore"):
        add(_KINDS[1], doc[run], _bucket(low[run] | low[run + 1] << np.uint64(8) | low[run + 2] << np.uint64(16), RUNS))
        at = np.flatnonzero(letter)
        first = np.searchsorted(at, begin)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        hashes = np.add.reduceat((low[at] + np.uint64(1)) * _POWERS[place & 63], first)
        owner = doc[begin]
        add(_KINDS[0], owner, _bucket(hashes, WORDS))
        same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out[:, TERMS - 2] = np.bincount(owner[1:][same], minlength=len(texts))
    out[:, TERMS - 1] = np.bincount(owner, minlength=len(texts)) - out[:, TERMS - 2]
    return out


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return ((x >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 1.0

    def project(self, found: np.ndarray) -> np.ndarray:
        """Unit latent vectors; texts without terms give zeros."""
        return _unit(_terms(found, self.weights).astype(np.float64) @ self.axes)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        vectors = self.project(counts([(t or "").encode() for t in texts]))
        for i in range(0, len(texts), BLOCK):
            top, near = self.nearest(vectors[i : i + BLOCK])
            vote = np.exp(20 * (near - 1))
            share = (vote * self.labels[top]).sum(axis=1) / vote.sum(axis=1)
            out[i : i + BLOCK] = np.where(near.max(axis=1) > 0, share, self.prior)
        return np.clip(out, 0.0, 1.0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of the labelled vectors nearest to each of ``vectors``, the nearest first."""
        m = len(self.labels)
        near = np.rint(vectors @ self.vectors.T * SCALE).astype(np.int64)
        key = near * m - np.arange(m)  # of equal ones the first row is the greatest
        top = np.argpartition(key, m - min(K, m), axis=1)[:, m - min(K, m) :]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, axis=1), axis=1), axis=1)
        return top, np.take_along_axis(near, top, axis=1) / SCALE


def _terms(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``found`` turned, in place, into weighted terms, every kind scaled to its share."""
    for kind, share in zip(_KINDS, SHARES):
        x = found[:, kind]
        total = x.sum(axis=1, keepdims=True)
        np.sqrt(x, out=x)
        x *= weights[kind]
        x *= share / np.maximum(np.linalg.norm(x, axis=1, keepdims=True) if share < 1 else np.sqrt(total), 1e-9)
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _axes(x: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors of ``x``, by power iterations of a fixed random start."""
    y = np.random.default_rng(1).standard_normal((x.shape[1], dimensions + 16)).astype(np.float32)
    for _ in range(4):
        y = np.linalg.qr(x.T @ (x @ y))[0]
    values, turn = np.linalg.eigh((small := x @ y).T @ small)
    return (y @ turn[:, ::-1])[:, :dimensions].astype(np.float64)


def learn(docs: DataFrame, labels: DataFrame, train, limit: int = SAMPLE) -> Model:
    """The labelled vectors of about ``limit`` rows with ``train`` true."""
    sample = _common.labelled_sample(docs, labels, "quality", train, limit).select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, BYTES, rows=ROWS):
            found = counts([(t or "").encode() for t in batch.column(0).to_pylist()])
            used = [np.flatnonzero(r).astype(np.int32) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in used], pa.binary()), pa.array([r[k].tobytes() for r, k in zip(found, used)], pa.binary()), batch.column(1)], ["terms", "counts", "label"])

    rows = sample.mapInArrow(run, "terms binary, counts binary, label int").collect()  # SAMPLE bounds them
    rows.sort(key=lambda r: (r.terms, r.counts, r.label))
    labels = np.array([float(r.label == 1) for r in rows])
    if not rows:
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1)), np.zeros((0, 1)), labels)
    found = np.zeros((len(rows), TERMS), np.float32)
    for row, r in zip(found, rows):
        row[np.frombuffer(r.terms, np.int32)] = np.frombuffer(r.counts, np.float32)
    return fitted(found, labels)


def fitted(found: np.ndarray, labels: np.ndarray) -> Model:
    weights = (np.log((1 + len(found)) / (1 + (found > 0).sum(axis=0))) + 1.0).astype(np.float32)
    x = _terms(found, weights)
    model = Model(weights, _axes(x, min(DIMENSIONS, len(x))), np.zeros((0, 1)), labels)
    model.vectors = np.concatenate([_unit(x[i : i + ROWS].astype(np.float64) @ model.axes) for i in range(0, len(x), ROWS)])
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row's whole ``text``."""
    picked = docs.select(key, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE and DIMENSIONS bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, BYTES, rows=ROWS):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()), pa.float64())], [key, "score"])

    return picked.mapInArrow(run, f"{key} {picked.schema[key].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows that score ``threshold`` or more, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in _common.slices(batches, BYTES, rows=ROWS):
            yield batch.filter(pa.array(shared.value.score(batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
