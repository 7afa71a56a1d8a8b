"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text is escaped (space -> U+2581, one such mark put before it), cut into words at every change from
another symbol to the mark and around symbols that no piece holds, and each distinct word is encoded once
per batch.  All new words of a batch lie in one flat numpy symbol array; a round looks up the rank of
every adjacent pair, takes the minimum per word, merges its leftmost non-overlapping occurrences at the
same time and compacts the array, until no pair of the vocabulary remains.

The sequential algorithm merges the pair of least rank, the leftmost of equal ones.  A merge may create a
pair of lower or equal rank ("hot"), which then comes before the remaining occurrences.  So of occurrences
that lie near each other all up to the first hot one are merged in a round.  Near is ``NEAR`` = 3 times
the longest piece: what follows from a merge stays inside a piece that holds the place of the merge, so
it neither changes nor sees symbols beyond that.  For the same reason a word longer than ``NEAR`` symbols
need not wait for its least pair: every pair that is least among those near it is merged at once.  The
number of rounds thus does not grow with the length of a word.

Edge cases: a null text counts as empty; the empty text has no ids and decodes to the empty text;
repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_FAR = np.iinfo(np.int32).max
#: Encoded words that a Python worker gathers before it lets go of those it has not met since.
CACHE_WORDS = 100_000


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message (wire format)."""
    i, n = 0, len(buf)

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = buf[i]
            i += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        else:
            width = {1: 8, 5: 4}.get(kind)
            width = varint() if width is None else width
            value = buf[i : i + width]
            i += width
        yield key >> 3, value


class PieceModel:
    """A BPE model with byte fallback and the identity normaliser, read from the bytes of its file."""

    def __init__(self, data: bytes):
        pieces, scores, kinds = [], [], []
        normalizer: dict[int, object] = {}
        for field, value in _fields(data):
            if field == 1:
                part = dict(_fields(value))
                pieces.append(part[1].decode())
                scores.append(np.frombuffer(part.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(part.get(3, NORMAL))
            elif field == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only models with the identity normaliser that keep white space are supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.pieces, self.kinds = pieces, kinds
        self.size = size = len(pieces)
        self.unk = kinds.index(UNKNOWN)
        self.byte_ids = np.full(256, self.unk, np.int32)
        for i, (piece, kind) in enumerate(zip(pieces, kinds)):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        self.alphabet = {c for p in self.ids for c in p}
        if not self.alphabet <= self.ids.keys() or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that cross words are not supported")
        self._pairs(np.array(scores))
        cut = "".join(sorted({"\n", "\t", "\r"} - self.alphabet))
        self.words = re.compile(f" *[^ {re.escape(cut)}]+|[{re.escape(cut)}]| +" if cut else " *[^ ]+| +")
        self.surface = [self._surface(i) for i in range(size)]
        self.cache: dict[str, tuple[list[int], str]] = {}
        self.old: dict[str, tuple[list[int], str]] = {}

    def _pairs(self, scores: np.ndarray) -> None:
        self.near = 3 * max(map(len, self.ids))
        by_score = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        rank = np.full(self.size, _FAR, np.int32)
        for i in self.ids.values():
            rank[i] = by_score[scores[i]]
        keys, ranks, merged = [], [], []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ranks.append(rank[i])
                    merged.append(i)
        order = np.argsort(keys)
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ranks = np.array(ranks, np.int32)[order]
        self.pair_merged = np.array(merged, np.int32)[order]

    def _surface(self, i: int) -> bytes | None:
        kind = self.kinds[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        if kind == BYTE:  # an ASCII byte is a character; the others count with their neighbours
            byte = int(self.pieces[i][3:5], 16)
            return bytes([byte]) if byte < 0x80 else None
        return self.pieces[i].replace(MARK, " ").encode()

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each (escaped, non-empty) word."""
        out: list[list[int]] = [[]] * len(words)
        for long in (False, True):
            which = [i for i, w in enumerate(words) if (len(w) > self.near) == long]
            if which:
                for i, ids in zip(which, self._merge([words[i] for i in which], long)):
                    out[i] = ids
        return out

    def _merge(self, words: list[str], long: bool) -> list[list[int]]:
        flat = "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        lookup = {c: self.ids.get(c, -1) for c in set(flat)}
        sym = np.fromiter(map(lookup.__getitem__, flat), np.int32, len(flat))
        odd = {int(k): flat[k] for k in np.flatnonzero(sym < 0)}  # symbols without a piece: bytes in the end
        place = np.arange(len(sym), dtype=np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        rank = np.empty(len(sym), np.int32)
        goal = np.empty(len(sym), np.int32)
        self._look_up(sym, word, np.arange(len(sym)), rank, goal)
        done = []
        while len(sym):
            if long:
                least = _least_near(rank, self.near, self.near)
                stay = np.ones(len(sym), bool)
            else:
                fresh = np.empty(len(sym), bool)
                fresh[0] = True
                np.not_equal(word[1:], word[:-1], out=fresh[1:])
                starts = np.flatnonzero(fresh)
                least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
                stay = least != _FAR
                if not stay.all():
                    done.append((sym[~stay], word[~stay], place[~stay]))
            own = (rank == least) & (rank != _FAR)
            hit = np.flatnonzero(own)
            if not len(hit):
                if long:
                    done.append((sym, word, place))
                break
            # an equal pair on the left that waits for a lesser one comes first
            held = _least_near(np.where(own, _FAR, rank), self.near, 0)[hit] == rank[hit] if long else np.zeros(len(hit), bool)
            hit = self._mergeable(hit, held, sym, word, rank, goal)
            sym[hit] = goal[hit]
            stay[hit + 1] = False
            shift = np.cumsum(stay) - 1
            at = shift[hit]
            sym, word, place, rank, goal = sym[stay], word[stay], place[stay], rank[stay], goal[stay]
            self._look_up(sym, word, np.concatenate([at, at[at > 0] - 1]), rank, goal)
        sym, word, place = (np.concatenate(x) for x in zip(*done)) if done else (sym, word, place)
        order = np.argsort(place, kind="stable")
        sym, word, place = sym[order], word[order], place[order]
        bounds = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        ids = sym.tolist()
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        if odd:
            for w in set(word[sym < 0].tolist()):
                a, b = bounds[w], bounds[w + 1]
                out[w] = [x for s, p in zip(ids[a:b], place[a:b].tolist()) for x in ([s] if s >= 0 else self.byte_ids[list(odd[p].encode())].tolist())]
        return out

    def _mergeable(self, hit: np.ndarray, held: np.ndarray, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Of the places of least pairs those that are merged in this round: the leftmost without overlap,
        and of neighbouring ones none after the first that creates a pair of lower or equal rank, and none
        from the first on that is ``held``."""
        n = np.arange(len(hit))
        apart = np.append(True, np.diff(hit) != 1)
        even = (n - np.maximum.accumulate(np.where(apart, n, 0))) & 1 == 0
        hit, held = hit[even], held[even]
        linked = np.append(False, (np.diff(hit) <= self.near) & (word[hit[1:]] == word[hit[:-1]]))
        if not linked.any():
            return hit[~held]
        m, r = goal[hit], rank[hit]
        before = np.where((hit > 0) & (word[hit - 1] == word[hit]), sym[hit - 1], -1)
        beside = np.flatnonzero(np.append(False, np.diff(hit) == 2) & linked)
        before[beside] = m[beside - 1]  # merged by then
        after_at = np.minimum(hit + 2, len(sym) - 1)
        after = np.where((hit + 2 < len(sym)) & (word[after_at] == word[hit]), sym[after_at], -1)
        stops = held | (self._ranks(before, m) <= r) | (self._ranks(m, after) <= r)
        before_it = np.cumsum(stops) - stops
        group = np.cumsum(~linked) - 1
        return hit[(before_it == before_it[~linked][group]) & ~held]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.full(len(left), _FAR, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[at].astype(np.int64) * self.size + right[at]
        k = np.searchsorted(self.pair_keys, key)
        k[k == len(self.pair_keys)] = 0
        good = self.pair_keys[k] == key
        out[at[good]] = self.pair_ranks[k[good]]
        return out

    def _look_up(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray, rank: np.ndarray, goal: np.ndarray) -> None:
        """Set rank and merged piece of the pairs that begin at the positions ``at``."""
        rank[at] = _FAR
        at = at[at + 1 < len(sym)]
        left, right = sym[at], sym[at + 1]
        good = (word[at] == word[at + 1]) & (left >= 0) & (right >= 0)
        at, key = at[good], left[good].astype(np.int64) * self.size + right[good]
        k = np.searchsorted(self.pair_keys, key)
        k[k == len(self.pair_keys)] = 0
        good = self.pair_keys[k] == key
        at, k = at[good], k[good]
        rank[at] = self.pair_ranks[k]
        goal[at] = self.pair_merged[k]

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(MARK, " ")
        return self.words.findall(" " + text if self.dummy_prefix else text)

    def learn(self, words: set[str]) -> None:
        """Encode and decode the words that are not at hand."""
        if len(self.cache) > CACHE_WORDS:  # words seen since the last change stay at hand
            self.old, self.cache = self.cache, {}
        new = []
        for w in words - self.cache.keys():
            known = self.old.get(w)
            if known is None:
                new.append(w)
            else:
                self.cache[w] = known
        for part in _common.chunked(new, 20_000):
            for w, ids in zip(part, self.merge([w.replace(" ", MARK) for w in part])):
                text = self._join(ids).decode()
                self.cache[w] = (len(ids), ",".join(map(str, ids)), w if text == w else text)

    def encode_words(self, texts: list[str]) -> Iterator[list[tuple[int, str, str]]]:
        """Per text its words' (number of ids, ids as text, decoded text)."""
        words = [self.split(t) for t in texts]
        self.learn({w for ws in words for w in ws})
        for ws in words:
            yield [self.cache[w] for w in ws]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for _, ids, _ in parts for i in ids.split(",")] for parts in self.encode_words(texts)]

    def round_trip(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids as text, decoded text).  The ids of a word stand for whole characters, so a
        text decodes to its decoded words; only the dummy prefix is taken off at its begin."""
        for parts in self.encode_words(texts):
            text = "".join([t for _, _, t in parts])
            yield sum([n for n, _, _ in parts]), ",".join([s for _, s, _ in parts]), text[1:] if self.dummy_prefix else text

    def _join(self, ids: list[int]) -> bytes:
        out = [self.surface[i] for i in ids]
        if None in out:
            out, run = [], bytearray()
            for i in ids:
                part = self.surface[i]
                if part is None:
                    run.append(int(self.pieces[i][3:5], 16))
                    continue
                if run:
                    out.append(_utf8(bytes(run)))
                    run.clear()
                out.append(part)
            if run:
                out.append(_utf8(bytes(run)))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any id list: marks become spaces, the first mark (dummy prefix) goes, runs of
        byte pieces become UTF-8 text with U+FFFD for each invalid byte."""
        ids = list(ids)
        while ids and self.kinds[ids[0]] == CONTROL:
            ids.pop(0)
        text = self._join(ids)
        if self.dummy_prefix and ids and self.kinds[ids[0]] == NORMAL and text[:1] == b" ":
            text = text[1:]
        return text.decode()


def _least_near(rank: np.ndarray, before: int, after: int) -> np.ndarray:
    """The least rank from ``before`` places before each to ``after`` places after it."""
    wide = np.concatenate([np.full(before, _FAR, rank.dtype), rank, np.full(after, _FAR, rank.dtype)])
    span, width = before + after + 1, 1
    while 2 * width <= span:
        wide = np.minimum(wide[:-width], wide[width:])
        width *= 2
    rest = span - width
    return np.minimum(wide[: len(wide) - rest], wide[rest:])


def _utf8(run: bytes) -> bytes:
    """The run if it is UTF-8, else with U+FFFD for each byte that starts no character."""
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                run[i : i + n].decode()
            except UnicodeDecodeError:
                continue
            if i + n <= len(run):
                out.append(run[i : i + n])
                i += n
                break
        else:
            out.append(b"\xef\xbf\xbd")
            i += 1
    return b"".join(out)


_MODELS: dict[str, PieceModel] = {}


def load(data: bytes) -> PieceModel:
    key = hashlib.sha256(data).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = PieceModel(data)
    return _MODELS[key]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def encode(docs: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>, decoded string) of every row's ``text``."""

    def shape(model: PieceModel, texts: list[str]) -> list[pa.Array]:
        rows = list(model.round_trip(texts))
        return [pa.array([[int(i) for i in ids.split(",")] if ids else [] for _, ids, _ in rows], pa.list_(pa.int32())), pa.array([t for _, _, t in rows], pa.string())]

    return _apply(docs, model_path, key, "ids array<int>, decoded string", shape)


def encode_digests(docs: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row's ``text``: digests of ``encode``."""

    def shape(model: PieceModel, texts: list[str]) -> list[pa.Array]:
        rows = [(n, _sha256(ids), _sha256(text)) for n, ids, text in model.round_trip(texts)]
        return [pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]

    return _apply(docs, model_path, key, "n_tokens long, ids_sha256 string, decoded_sha256 string", shape)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _apply(docs: DataFrame, model_path: str, key: str, columns: str, shape) -> DataFrame:
    with open(model_path, "rb") as f:  # a vocabulary file of the driver; its size bounds the broadcast
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(data.value)
        gc.disable()  # millions of small strings and tuples without cycles
        try:
            for batch in _common.slices(batches, 1_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0), *shape(model, _texts(batch))], names)
        finally:  # the worker goes on to other tasks
            gc.enable()

    picked = docs.select(key, "text")
    names = [key, *(c.split()[0] for c in columns.split(", "))]
    return picked.mapInArrow(run, f"{key} {picked.schema[key].dataType.simpleString()}, {columns}")
