"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows.

Words: A-Z are lower-cased, every ASCII character that is no letter or digit separates, everything beyond
ASCII belongs to words.  A test item's windows are its runs of ``n`` consecutive words; an item of fewer
words, but not none, is one window.  Document words become ids of the test vocabulary (-1 elsewhere); a
rolling hash of the ids finds windows of the set, and each hit is compared id by id.

The window set is broadcast only up to about ``max_windows`` windows a time: a larger test set is dealt by
hash into blocks, each scanned on its own, and the hits of all blocks are put together for every row.

Edge cases: a null or empty text has no words; an item without words has no window; a null item_id counts
as one item written as the empty text; items may repeat (equal windows belong to all of them); an empty
benchmark hits nothing; an empty table gives an empty result; extra columns are ignored by ``scan`` and
kept by ``remove``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common

N = 8
#: Windows in one broadcast block (about 100 bytes each); windows of an item that go to a block together.
MAX_WINDOWS, PIECE = 2_000_000, 50_000
_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


class WindowSet:
    """The windows of test items, looked up by length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int = N):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = sorted({name for name, _ in items})
        of = {name: k for k, name in enumerate(self.names)}
        windows: dict[tuple[int, ...], set[int]] = {}
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            for i in range(max(1, len(ids) - n + 1)) if ids else ():
                windows.setdefault(tuple(ids[i : i + n]), set()).add(of[name])
        self.by_length = []
        for length in sorted({len(w) for w in windows}):
            grams = [w for w in windows if len(w) == length]
            table = np.array(grams, np.int64)
            keys = _rolling(table.ravel(), length)[::length] if len(grams) else np.zeros(0, np.uint64)
            order = np.argsort(keys, kind="stable")
            self.by_length.append((length, keys[order], table[order], [windows[grams[k]] for k in order]))

    def scan(self, words: list[bytes]) -> tuple[int, int, set[int]]:
        """(number of words, number of hit words, items)."""
        marks, items = self.hits(words)
        return len(words), int(marks.sum()), items

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and by which items."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        marks, items = np.zeros(len(words) + 1, np.int32), set()
        known = ids >= 0
        if known.any():
            unknown_before = np.append(0, np.cumsum(~known))
            for length, keys, table, of in self.by_length:
                if len(ids) < length:
                    continue
                starts = np.flatnonzero(unknown_before[length:] == unknown_before[:-length])
                if not len(starts):
                    continue
                got = _at(ids, starts, length)
                k = np.searchsorted(keys, got)
                live = k < len(keys)
                starts, got, k = starts[live], got[live], k[live]
                while len(starts):  # as many windows as share a hash
                    same = keys[k] == got
                    starts, got, k = starts[same], got[same], k[same]
                    true = (ids[starts[:, None] + np.arange(length)] == table[k]).all(axis=1) if len(starts) else np.zeros(0, bool)
                    np.add.at(marks, starts[true], 1)
                    np.add.at(marks, starts[true] + length, -1)
                    for j in set(k[true].tolist()):
                        items |= of[j]
                    k = k + 1
                    live = k < len(keys)
                    starts, got, k = starts[live], got[live], k[live]
        return np.cumsum(marks[:-1]) > 0, items


def _weights(length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(length, _MIX))


def _rolling(ids: np.ndarray, length: int) -> np.ndarray:
    return _at(ids, np.arange(len(ids) - length + 1), length)


def _at(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for j, w in enumerate(_weights(length)):
            out += (ids[starts + j].astype(np.uint64) + np.uint64(1)) * w
            out ^= out >> np.uint64(29)
    return out


def _pieces(benchmark: DataFrame, n: int) -> DataFrame:
    """(item, piece, windows): the distinct items, each cut into runs of ``PIECE`` windows, which overlap by
    n - 1 words, so that no block of windows hangs on the length of one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                last = max(1, len(words) - n + 1)
                for parts in _common.chunked(range(0, last if words else 0, PIECE), 64):
                    pieces = [b" ".join(words[i : min(i + PIECE, last) + n - 1]).decode() for i in parts]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(pieces), pa.string()), pa.array(pieces, pa.string()), pa.array([min(i + PIECE, last) - i for i in parts], pa.int64())], ["item", "piece", "windows"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return items.mapInArrow(run, "item string, piece string, windows long").distinct()


def _marked(docs: DataFrame, benchmark: DataFrame, n: int, max_windows: int, shape, schema) -> DataFrame:
    """``shape(batch, found)`` of all rows, in batches of ``docs`` with a list of (words hit, items).

    A test set of one block is scanned in passing.  For a larger one the rows get a number, which is written
    with them, so that it stays theirs whatever scans the table again; every block of windows is scanned on
    its own, and the hits of all blocks meet by that number."""
    pieces = _pieces(benchmark, n)
    total = pieces.agg(F.sum("windows")).first()[0] or 0
    blocks = max(1, -(-total // max_windows))
    at = docs.columns.index("text")
    if blocks == 1:
        shared = _shared(pieces)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = _loaded(shared, n)
            for batch in _common.slices(batches):
                found = []
                for text in batch.column(at).to_pylist():
                    marks, which = windows.hits(words_of(text))
                    found.append((marks, {windows.names[k] for k in which}))
                yield shape(batch, found)

        return docs.mapInArrow(run, schema)
    row, hit, item = (_common.free_name(docs, c) for c in ("_row", "_marks", "_items"))
    rows = _common.written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    pieces = _common.written(pieces.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(blocks))), "pieces")
    parts = []
    for b in range(blocks):
        shared = _shared(pieces.where(F.col("block") == b))

        def scan_block(batches, shared=shared):
            windows = _loaded(shared, n)
            for batch in _common.slices(batches):
                keep, spans, which = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    marks, got = windows.hits(words_of(text))
                    if got:
                        keep.append(i)
                        spans.append(np.packbits(marks).tobytes())
                        which.append([windows.names[k] for k in got])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(spans, pa.binary()), pa.array(which, pa.list_(pa.string()))], [row, hit, item])

        parts.append(rows.select(row, "text").mapInArrow(scan_block, f"{row} long, {hit} binary, {item} array<string>"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = hits.groupBy(row).agg(F.collect_list(hit).alias(hit), F.flatten(F.collect_list(item)).alias(item))  # at most a row for each block
    width = len(docs.columns)

    def merge(batches):
        for batch in _common.slices(batches):
            found = []
            for text, marks, which in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()):
                count = len(words_of(text))
                union = np.zeros(count, bool)
                for m in marks or []:
                    union |= np.unpackbits(np.frombuffer(m, np.uint8), count=count).astype(bool)
                found.append((union, set(which or [])))
            yield shape(batch.select(range(width)), found)

    return rows.join(hits, row, "left").select(*docs.columns, hit, item).mapInArrow(merge, schema)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, min_items: int = 2, max_windows: int = MAX_WINDOWS, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, items) of every document."""
    columns = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    picked = docs.select(key, "text")
    names = [key, *(c.split()[0] for c in columns.split(", "))]

    def shape(batch: pa.RecordBatch, found) -> pa.RecordBatch:
        lists = [sorted(which) for _, which in found]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(m) for m, _ in found], pa.int64()), pa.array([int(m.sum()) for m, _ in found], pa.int64()), pa.array([len(x) for x in lists], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists], pa.string()), pa.array([len(x) >= min_items for x in lists], pa.bool_()), pa.array(lists, pa.list_(pa.string()))],
            names,
        )

    return _marked(picked, benchmark, n, max_windows, shape, f"{key} {picked.schema[key].dataType.simpleString()}, {columns}")


def _shared(pieces: DataFrame):
    """A broadcast of (a name of its own, the items' pieces): the windows of one block."""
    return pieces.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.item, r.piece) for r in pieces.select("item", "piece").collect()]))


_LOADED: list[tuple[str, int, WindowSet]] = []


def _loaded(shared, n: int) -> WindowSet:
    """The window set of a broadcast, built once in a Python worker."""
    name, items = shared.value
    for held, length, windows in _LOADED:
        if held == name and length == n:
            return windows
    windows = WindowSet([(item, words_of(text)) for item, text in items], n)
    _LOADED[:] = [(name, n, windows)]
    return windows


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = N, min_items: int = 2, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents without contaminated ones (``mode="documents"``), all columns kept; or, with
    ``mode="spans"``, all documents, in which every hit run of words is cut out of ``text``."""
    at = docs.columns.index("text")

    def clean(batch: pa.RecordBatch, found) -> pa.RecordBatch:
        return batch.filter(pa.array([len(which) < min_items for _, which in found], pa.bool_()))

    def cut(batch: pa.RecordBatch, found) -> pa.RecordBatch:
        texts = [_without(text, marks) if which else text for text, (marks, which) in zip(batch.column(at).to_pylist(), found)]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode}")
    return _marked(docs, benchmark, n, max_windows, clean if mode == "documents" else cut, docs.schema)


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _without(text: str, marks: np.ndarray) -> str:
    """The text without its marked words and what stands between neighbouring ones."""
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw.translate(_KEEP))]
    edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    out, begin = [], 0
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
        out.append(raw[begin : spans[a][0]])
        begin = spans[b - 1][1]
    return b"".join([*out, raw[begin:]]).decode()
