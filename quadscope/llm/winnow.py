"""Document fingerprints by winnowing.

Rolling hashes of all ``K``-grams of code points; in every window of ``W`` grams the least hash is chosen,
the rightmost of equal ones; the chosen (position, hash) pairs are the fingerprint.  Any passage of
``W + K - 1`` code points that two texts share gives both an equal chosen hash.  A text shorter than
``K`` is one gram; one of fewer than ``W`` grams is one window.  The likeness of two fingerprints is the
Jaccard similarity of their hash sets (1 if both are empty).

Pairs with the next document need no global sort of texts: quantiles of doc_id deal the rows into buckets,
every bucket also gets a copy of the row that follows it, and neighbours meet inside the sorted buckets.
A doc_id, or the lack of one, that holds a large share of the rows is dealt over buckets by the texts' hash.

Edge cases: a null text counts as empty, and the empty text has an empty fingerprint; rows of equal doc_id
follow one another by a hash of their text, null doc_ids come after all others; a single row is its own
next; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common

K, W = 16, 16
_GAP = K + W
_BASE = 0x9E3779B97F4A7C15
_HASH_BITS = 40
_LOW = np.uint64((1 << 24) - 1)
#: Code points fingerprinted at a time; positions inside such a stretch take 24 bits.
STRETCH = 1 << 22
#: Rows of one doc_id from which it may be dealt over buckets; buckets of one doc_id at most.
HEAVY, _DEAL = 1_000, 1 << 20
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def select(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the chosen grams, in order."""
    parts, group, size = [], [], 0
    for i, text in enumerate(texts):
        if len(text) > STRETCH:
            parts.append(_select(group, texts))
            parts.append(_select_long(i, text))
            group, size = [], 0
            continue
        if size + len(text) + _GAP > STRETCH + _GAP and group:
            parts.append(_select(group, texts))
            group, size = [], 0
        group.append(i)
        size += len(text) + _GAP
    parts.append(_select(group, texts))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _select_long(i: int, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text in stretches that overlap by a window less one, so that every window lies in one of them."""
    step = STRETCH - (W + K - 2)
    places, hashes = [], []
    for begin in range(0, len(text), step):
        piece = text[begin : begin + STRETCH]
        if begin and len(piece) < W + K - 1:
            break
        _, at, got = _select([0], [piece])
        places.append(at + begin)
        hashes.append(got)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return np.full(len(at), i), at, np.concatenate(hashes)[first]


def _select(group: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(texts[i]) for i in group], np.int64)
    if not lengths.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gap = "\0" * _GAP
    flat = np.frombuffer(gap.join([*(texts[i] for i in group), ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.cumsum(np.append(0, lengths[:-1] + _GAP))
    with np.errstate(over="ignore"):
        flat += np.uint64(1)
        power, width, h = np.uint64(_BASE), 1, flat
        while width < K:  # the hash of 2n symbols from two of n
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_BASE)
    # least key = least hash; of equal hashes the rightmost position
    place = np.arange(len(h), dtype=np.uint64)
    key = (h & ~_LOW) | (_LOW - place)
    grams = np.maximum(lengths - K + 1, np.minimum(lengths, 1))
    edge = np.zeros(len(h) + 1, np.int8)
    edge[starts] += (grams > 0).astype(np.int8)
    np.add.at(edge, starts + grams, -(grams > 0).astype(np.int8))
    key[np.cumsum(edge[:-1], dtype=np.int8) == 0] = _FAR
    least, width = key, 1
    while width < W:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    windows = np.maximum(grams - W + 1, np.minimum(grams, 1))
    edge = np.zeros(len(least) + 1, np.int8)
    edge[starts[windows > 0]] += 1
    np.add.at(edge, (starts + windows)[windows > 0], -1)
    at = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    least = least[at]
    new = np.append(True, least[1:] != least[:-1])
    chosen = least[new]
    position = (_LOW - (chosen & _LOW)).astype(np.int64)
    text = np.searchsorted(starts, position, side="right") - 1
    return np.array(group, np.int64)[text], position - starts[text], chosen >> np.uint64(64 - _HASH_BITS)


def _sets(number: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Distinct (text number, hash), sorted, in one word each (numbers below 2^24)."""
    return np.unique((number.astype(np.uint64) << np.uint64(_HASH_BITS)) | hashes)


def _likeness(a: np.ndarray, b: np.ndarray, pairs: int) -> np.ndarray:
    """Jaccard similarity of pair i: the hashes under number i in ``a`` and in ``b``."""
    both = np.sort(np.concatenate([a, b]))
    common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(_HASH_BITS)).astype(np.int64), minlength=pairs)[:pairs]
    union = np.bincount((both >> np.uint64(_HASH_BITS)).astype(np.int64), minlength=pairs)[:pairs] - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def _digests(number: np.ndarray, position: np.ndarray, hashes: np.ndarray, texts: int) -> list[str]:
    bounds = np.searchsorted(number, np.arange(texts + 1))
    table = np.stack([position.astype("<u8"), hashes.astype("<u8")], axis=1)
    return [hashlib.sha256(table[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]


def fingerprint(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, positions array<long>, hashes array<long>) of every row's ``text``."""
    picked = docs.select(key, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, 1_000_000):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            number, position, hashes = select(texts)
            offsets = pa.array(np.searchsorted(number, np.arange(len(texts) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(position)), pa.ListArray.from_arrays(offsets, pa.array(hashes.astype(np.int64)))], [key, "positions", "hashes"])

    return picked.mapInArrow(run, f"{key} {picked.schema[key].dataType.simpleString()}, positions array<long>, hashes array<long>")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (_bucket, _copy, doc_id, text), partitioned by bucket and sorted so that the row after each one
    with ``_copy`` 0 is the next document, descending doc_id; after the last comes the first."""
    spark = docs.sparkSession
    ids = docs.select("doc_id", F.xxhash64("text").alias("h"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, cuts = ids.agg(F.count("*"), F.percentile_approx("doc_id", [i / (4 * parts) for i in range(1, 4 * parts)], 100 * parts)).first()
    # an id of more than a thousandth of the rows (fewer than 1,000 have so many) is a bucket of its own, dealt by hash
    heavy = ids.groupBy("doc_id").count().where(F.col("count") > max(HEAVY, total // 1000)).collect()
    named = [r.doc_id for r in heavy if r.doc_id is not None]
    bounds = np.unique(np.array([*(cuts or []), *named, *(i + 1 for i in named)], np.int64))

    def of(x: pd.Series) -> np.ndarray:
        own = len(bounds) - np.searchsorted(bounds, x.fillna(0).to_numpy().astype(np.int64), side="right")
        return np.where(x.isna().to_numpy(), len(bounds) + 1, own)

    deal = np.ones(len(bounds) + 2, np.int64)
    for r in heavy:
        deal[of(pd.Series([r.doc_id], dtype="Int64"))[0]] = min(_DEAL - 1, -(-r["count"] * 4 * parts // total))

    def coded(x: pd.Series, h: pd.Series) -> np.ndarray:
        own = of(x)
        nth = np.floor((h.to_numpy().astype(np.float64) / 2.0**64 + 0.5) * deal[own]).astype(np.int64)
        return own * _DEAL + np.minimum(nth, deal[own] - 1)

    @F.pandas_udf("long")
    def bucket(x: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(coded(x, h))

    heads = sorted(tuple(r) for r in ids.groupBy(bucket("doc_id", "h").alias("b")).agg(F.max("doc_id").alias("head"), F.min("h").alias("low")).collect())  # as many as buckets
    codes = np.array([b for b, _, _ in heads], np.int64)
    head, low = np.array([i or 0 for _, i, _ in heads], np.int64), np.array([h for *_, h in heads], np.int64)
    before = np.roll(codes, 1)

    @F.pandas_udf("bucket long, to long")
    def place(x: pd.Series, h: pd.Series) -> pd.DataFrame:
        code = coded(x, h)
        k = np.searchsorted(codes, code)
        by_hash = x.isna().to_numpy() | (deal[code // _DEAL] > 1)
        first = np.where(by_hash, h.to_numpy() == low[k], x.fillna(0).to_numpy().astype(np.int64) == head[k])
        return pd.DataFrame({"bucket": code, "to": np.where(first, before[k], -1)})

    rows = docs.select("doc_id", "text", place("doc_id", F.xxhash64("text")).alias("_at"))
    own, copy = F.struct(F.col("_at.bucket").alias("b"), F.lit(0).alias("c")), F.struct(F.col("_at.to").alias("b"), F.lit(1).alias("c"))
    dealt = rows.select("doc_id", "text", F.explode(F.when(F.col("_at.to") >= 0, F.array(own, copy)).otherwise(F.array(own))).alias("_d")).select(F.col("_d.b").alias("_bucket"), F.col("_d.c").alias("_copy"), "doc_id", "text")
    return dealt.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_copy", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")


def compare_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): every text,
    and the text whose last third is replaced by the begin of the next document."""
    rows = with_next(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(texts: list[str], real: np.ndarray) -> list[pa.Array]:
        """Of every text with ``real`` true, which is never the last."""
        m = len(texts)
        number, position, hashes = select(texts)
        edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] if r else "" for a, b, r in zip(texts, texts[1:], real)]
        e_number, e_position, e_hashes = select(edited) if edited else (number, position, hashes)
        sets = _sets(number, hashes)
        follows = sets[sets >= np.uint64(1 << _HASH_BITS)] - np.uint64(1 << _HASH_BITS)  # under the number before
        near = _likeness(sets, follows, m)
        near_edited = _likeness(sets, _sets(e_number, e_hashes), m)
        keep = np.flatnonzero(real)
        own, other = _digests(number, position, hashes, m), _digests(e_number, e_position, e_hashes, len(edited))
        return [
            pa.array([len(texts[i]) for i in keep], pa.int64()),
            pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()),
            pa.array([own[i] for i in keep], pa.string()),
            pa.array([other[i] for i in keep], pa.string()),
            pa.array(near_edited[keep], pa.float64()),
            pa.array(near[keep], pa.float64()),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        flags: list[bool] = []
        kind = None
        for batch in _common.slices(batches, 1_000_000):
            kind = batch.schema.field("doc_id").type
            ids += batch.column(2).to_pylist()
            texts += [t or "" for t in batch.column(3).to_pylist()]
            flags += [c == 0 for c in batch.column(1).to_pylist()]
            real = np.array(flags)
            real[-1] = False  # waits for the row after it
            yield pa.RecordBatch.from_arrays([pa.array([i for i, r in zip(ids, real) if r], kind), *compare(texts, real)], names)
            ids, texts, flags = ids[-1:], texts[-1:], flags[-1:]

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
