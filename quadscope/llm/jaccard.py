"""N-gram Jaccard join by signature trees.

A document's set holds the 64-bit hashes of its distinct word 5-grams; two documents link when their sets'
Jaccard similarity is 0.8 or more.  Equal sets are one class from the start: ``ref`` is a 64-bit digest of
the set, ``also`` 64 bits more.  If two sets of a table share a ref, which ``also`` tells, the table is
scanned again with another seed, so classes rest on 128 bits while only 64 of them are shuffled.

1. One scan gives every row's set size and class, and a count sketch of fixed width over all shingles.
2. In the global order (sketch count, hash), two sets that link share a shingle within their prefixes of
   ``n - ceil(0.8 n) + 1``.  Rows (shingle, class, n, reach) meet by shingle, where ``reach`` is the largest
   set that can link if this is the first common shingle: with ``i`` shingles before it, ``(5 n - 9 i) / 4``.
   Of a few classes, every pair within each other's reach joins the block of its smaller set; more of them
   are cut where no set reaches on, and a piece joins the block of its smallest set.  So every linking
   pair lies in some block.  Shingles that the sketch finds in a large share of all rows are dealt over
   many tasks and cut the same way by sums over set sizes.
3. Blocks are cut by set size into chunks of bounded size; each chunk also gets the block's leader.  In a chunk the
   leader is compared with all, then a signature tree over the chunk (nodes hold the OR of token bitmaps,
   the range of set sizes and the largest number of tokens beyond set bits) is joined with itself by dual
   traversal: node pairs whose largest possible overlap is too small, or that are connected already, are
   pruned, and what is left is compared exactly.
4. For blocks of several chunks, chunks that hold more than one component are joined with the others
   within reach of their sizes by the same traversal of their two trees.
5. The links (a spanning forest of them) become components by alternating large-star and small-star rounds.
   Classes, components and nodes that hold more than a thousandth of the rows of a join, fewer than a
   thousand, are joined by broadcast, so no key's rows meet in one task.

Nothing is capped: no class, block, candidate or link is dropped.

Edge cases: null and empty texts, and texts without words, have empty sets and link with nothing (their
component is their own doc_id); texts of fewer than five words have one shingle, the whole sequence;
repeated rows belong to one class; rows of null doc_id link by their text, and take no part in the least
doc_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common

SHINGLE, SHARE, OF = 5, 4, 5  # words; a link has SHARE / OF similarity or more
SKETCH, SKETCH_ROW = 1 << 20, 1 << 12
#: Classes, and tokens, of a chunk.
CHUNK, CHUNK_TOKENS = 512, 2_000_000
#: A shingle that the sketch finds in one of so many rows is dealt over SALTS tasks.
HOT_SHARE, HOT_LEAST, SALTS = 200, 1000, 64
#: Such shingles, and memberships in blocks or rows to be dropped, of which a broadcast is made; more are joined by a shuffle.
HOT_FEW, ROWS_FEW = 100_000, 500_000
#: Bits of the broadcast filter of classes that take part in a block (false ones only cost time).
FILTER_BITS, FILTER_PARTS = 1 << 23, 16
#: Bits of a set's bitmap at least and at most (twice the tokens of the largest set between), bytes of a tree's lowest level.
BITMAP, BITMAP_MOST, LEVEL_BYTES, FANOUT = 1024, 1 << 16, 1 << 25, 8
#: Classes of a shingle of which all pairs are looked at; rows of a shingle that a task holds at most.
FEW, GIANT = 9, 50_000

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _P, np.uint64))


_POW = _powers(1 << 12)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _Q
        h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    global _POW
    raws = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    solid = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return [np.zeros(0, np.uint64)] * len(texts)
    at = np.flatnonzero(solid)
    size = end - begin
    if size.max() > len(_POW):
        _POW = _powers(int(size.max()))
    first = np.cumsum(np.append(0, size[:-1]))
    with np.errstate(over="ignore"):
        word = _mix(np.add.reduceat((_LOWER[raw[at]] + np.uint64(1)) * _POW[np.arange(len(at)) - np.repeat(first, size)], first) + size.astype(np.uint64))
        gram = word[: max(0, len(word) - SHINGLE + 1)].copy()
        for k in range(1, SHINGLE):
            gram = gram * _P + word[k : k + len(gram)]
        gram = _mix(gram)
        bounds = np.append(0, np.searchsorted(begin, ends)).tolist()
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= SHINGLE:
                out.append(np.unique(gram[a : b - SHINGLE + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in word[a:b]:
                    h = h * _P + w
                out.append(_mix(np.array([h], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _names(tokens: np.ndarray, seed: int) -> tuple[int, int]:
    """The 64-bit name of a set, and 64 more bits that tell whether two sets share it."""
    both = hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def _ref(tokens: np.ndarray, seed: int) -> int:
    return _names(tokens, seed)[0]


def _needed(n: int) -> int:
    return -(-SHARE * n // OF)


def _linked(common: int, a: int, b: int) -> bool:
    return OF * common >= SHARE * (a + b - common)


# --- signature trees


_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _popcount(bits: np.ndarray) -> np.ndarray:
    if hasattr(np, "bitwise_count"):
        return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)
    return _ONES[bits.view(np.uint16)].sum(axis=-1, dtype=np.int64)


class Tree:
    """A signature tree over sets: level 0 holds the sets, each further level a node for FANOUT below.
    Trees that are joined need bitmaps of equal ``width``."""

    def __init__(self, sets: list[np.ndarray], component: np.ndarray, width: int):
        self.sets = sets
        bits = np.zeros((len(sets), width // 64), np.uint64)
        for row, tokens in zip(bits, sets):
            slot = (tokens % np.uint64(width)).astype(np.int64)
            np.bitwise_or.at(row, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
        sizes = np.array([len(s) for s in sets], np.int64)
        beyond = sizes - _popcount(bits)
        self.levels = [(bits, sizes, sizes, beyond, np.asarray(component, np.int64))]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, beyond, component = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            one = np.minimum.reduceat(component, cut) == np.maximum.reduceat(component, cut)
            self.levels.append((np.bitwise_or.reduceat(bits, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(beyond, cut), np.where(one & (component[cut] >= 0), component[cut], -1)))

    def node(self, level: int):
        return self.levels[min(level, len(self.levels) - 1)]


def width_for(*groups: list[np.ndarray]) -> int:
    """Bits of a bitmap that fit the sets of the groups: a set of some thousand tokens would fill a small one."""
    largest = max(len(s) for sets in groups for s in sets)
    room = LEVEL_BYTES * 8 // max(len(sets) for sets in groups)
    width = BITMAP
    while width < 2 * largest and width < BITMAP_MOST and 2 * width <= room:
        width *= 2
    return width


def _survive(a, b, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which node pairs can hold a link between components."""
    bits_a, low_a, high_a, beyond_a, comp_a = (x[i] for x in a)
    bits_b, low_b, high_b, beyond_b, comp_b = (x[j] for x in b)
    keep = (OF * high_a >= SHARE * low_b) & (OF * high_b >= SHARE * low_a) & ~((comp_a == comp_b) & (comp_a >= 0))
    overlap = _popcount(bits_a & bits_b) + np.minimum(beyond_a, beyond_b)
    return keep & ((SHARE + OF) * overlap >= SHARE * (low_a + low_b))


def traverse(a: Tree, b: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that no bound excludes, in parts.  ``a is b`` joins a tree with itself."""
    same = a is b
    top = max(len(a.levels), len(b.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        keep = _survive(a.node(level), b.node(level), i, j)
        i, j = i[keep], j[keep]
        if level == 0:
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        i, j = _children(a, level, i, j)
        j, i = _children(b, level, j, i)
        if same:
            keep = i <= j
            i, j = i[keep], j[keep]
        for k in range(0, len(i), 1 << 16):
            stack.append((level - 1, i[k : k + (1 << 16)], j[k : k + (1 << 16)]))


def _children(tree: Tree, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if level >= len(tree.levels):  # the lower tree waits at its root
        return i, j
    below = len(tree.levels[level - 1][1])
    child = i[:, None] * FANOUT + np.arange(FANOUT)
    at = child < below
    return child[at], np.broadcast_to(j[:, None], child.shape)[at]


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _common_tokens(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _against_one(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Common tokens of one set with each."""
    flat = np.concatenate(sets)
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum([0, *(len(s) for s in sets[:-1])]))


def chunk_links(sets: list[np.ndarray], leader: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets: the leader against all, then the self-join."""
    union, out = _Union(len(sets)), []
    for i, c in enumerate(_against_one(sets[leader], sets).tolist()):
        if i != leader and _linked(c, len(sets[leader]), len(sets[i])) and union.join(leader, i):
            out.append((leader, i))
    order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))  # near copies come together
    component = np.array([union.find(i) for i in order], np.int64)
    if (component == component[0]).all():
        return out
    tree = Tree([sets[i] for i in order], component, width_for(sets))
    for i, j in traverse(tree, tree):
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = order[x], order[y]
            if union.find(x) != union.find(y) and _linked(_common_tokens(sets[x], sets[y]), len(sets[x]), len(sets[y])):
                union.join(x, y)
                out.append((x, y))
    return out


def cross_links(left: list[np.ndarray], left_of: list[int], right: list[np.ndarray], right_of: list[int]) -> list[tuple[int, int]]:
    """Links between sets of different components (given as small numbers), by two trees."""
    pair, width = [], width_for(left, right)
    for sets, of in ((left, left_of), (right, right_of)):
        order = sorted(range(len(sets)), key=lambda i: (of[i], int(sets[i][0]), len(sets[i])))
        pair.append((order, Tree([sets[i] for i in order], np.array([of[i] for i in order]), width)))
    (order_l, a), (order_r, b) = pair
    union, out = _Union(max([*left_of, *right_of]) + 1), []
    for i, j in traverse(a, b):
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = order_l[x], order_r[y]
            if union.find(left_of[x]) != union.find(right_of[y]) and _linked(_common_tokens(left[x], right[y]), len(left[x]), len(right[y])):
                union.join(left_of[x], right_of[y])
                out.append((x, y))
    return out


# --- the distributed join


def _scan(docs: DataFrame, seed: int) -> DataFrame:
    """Per row (doc_id, tag, n, ref, also), where ``tag`` is a hash of the text; and per task the rows
    (part, counts) of its sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.uint32)
        names = ["doc_id", "tag", "n", "ref", "also", "part", "counts"]
        ids = pa.int64()
        for batch in _common.slices(batches, 1_000_000):
            ids = batch.column(0).type
            sets = shingle_sets(batch.column(1).to_pylist())
            np.add(sketch, np.bincount((np.concatenate(sets) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint32), out=sketch)
            m, named = len(sets), [_names(s, seed) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*named)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        rows = sketch.reshape(-1, SKETCH_ROW)
        used = np.flatnonzero(rows.any(axis=1))
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), ids), none, none, none, none, pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(run, f"doc_id {kind}, tag long, n long, ref long, also long, part int, counts binary")


def _sketch(parts: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches: 4 MB, whatever the input."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(counts, np.uint32)
                total[part] = total[part] + got if part in total else got.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "counts"])

    out = np.zeros((SKETCH // SKETCH_ROW, SKETCH_ROW), np.uint64)
    for r in parts.repartition("part").mapInArrow(add, "part int, counts binary").collect():
        out[r.part] += np.frombuffer(r.counts, np.uint64)
    return out.ravel()


def _prefixes(docs: DataFrame, sketch: np.ndarray, rows: int, seed: int) -> DataFrame:
    """(token, salt, info, ref): the prefix shingles of every class, once a task; ``info`` is the set's size
    and the shingle's place in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch.astype(np.uint32 if sketch.max(initial=0) < 2**32 else np.uint64))  # SKETCH bounds it
    hot = max(HOT_LEAST, rows // HOT_SHARE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in _common.slices(batches, 1_000_000):
            tokens, refs, sizes = [], [], []
            for s in shingle_sets(batch.column(0).to_pylist()):
                if not len(s) or (ref := _ref(s, seed)) in seen:
                    continue
                seen.add(ref)
                n = len(s)
                rank = counts[(s % np.uint64(SKETCH)).astype(np.int64)]
                tokens.append(s[np.argsort(rank, kind="stable")[: n - _needed(n) + 1]])
                refs.append(ref)
                sizes.append(n)
            if not tokens:
                continue
            lengths = [len(t) for t in tokens]
            place = np.concatenate([np.arange(k) for k in lengths])
            flat, ref, n = np.concatenate(tokens), np.repeat(np.array(refs, np.int64), lengths), np.repeat(np.array(sizes, np.int64), lengths)
            salt = np.where(counts[(flat % np.uint64(SKETCH)).astype(np.int64)] >= hot, 1 + ref % SALTS, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(salt), pa.array((n << 32) | place), pa.array(ref)], ["token", "salt", "info", "ref"])

    return docs.select("text").mapInArrow(run, "token long, salt int, info long, ref long")


def _reach(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (OF * n - (SHARE + OF) * place) // SHARE


def _pairs_of_run(token, salt, ref, n, reach, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """(row of the block's set, row of a member) for whole runs of equal (token, salt), sorted by n, ref."""
    new = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
    run = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(token)))
    small = length <= few
    left, right = [], []
    for gap in range(1, few):
        k = np.flatnonzero((run[gap:] == run[:-gap]) & small[run[:-gap]]) if gap < len(run) else np.zeros(0, np.int64)
        k = k[(n[k + gap] <= reach[k]) & (n[k] <= reach[k + gap])]
        left.append(k)
        right.append(k + gap)
    for r in np.flatnonzero(~small):
        rows = np.arange(start[r], start[r] + length[r])
        far = np.maximum.accumulate(reach[rows])
        piece = np.append(0, np.cumsum(n[rows][1:] > far[:-1]))
        head = rows[np.searchsorted(piece, piece)]
        keep = head != rows
        left.append(head[keep])
        right.append(rows[keep])
    return np.concatenate(left), np.concatenate(right)


def _memberships(prefixes: DataFrame) -> DataFrame:
    """(lead, lead_n, token, ref, n, reach): classes that may link with others, in the block of ``lead``;
    where a shingle is dealt over tasks, ``lead`` is still open (null), and ``token`` and ``reach`` are set."""
    names = ["lead", "lead_n", "token", "ref", "n", "reach"]
    few, most = FEW, GIANT

    def told(lead, lead_n, ref, n) -> pa.RecordBatch:
        none = pa.nulls(len(lead), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(lead), pa.array(lead_n), none, pa.array(ref), pa.array(n), none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64, np.int64)]
        giant = None  # (token, salt, its smallest set, n) of a run too long to be held
        for batch in batches:
            token, salt, info, ref = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            size = info >> 32
            cols = [np.concatenate([r, c]) for r, c in zip(rest, (token, salt, ref, size, _reach(size, info & 0xFFFFFFFF)))]
            if not len(cols[0]):
                continue
            warm = cols[1] != 0
            if warm.any():
                none = pa.nulls(warm.sum(), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *(pa.array(cols[k][warm]) for k in (0, 2, 3, 4))], names)
                cols = [c[~warm] for c in cols]
                if not len(cols[0]):  # nothing was carried over either: ``rest`` holds no warm row
                    continue
            token, salt, ref, n, reach = cols
            again = np.append(False, (token[1:] == token[:-1]) & (ref[1:] == ref[:-1]))  # a class from several tasks
            token, salt, ref, n, reach = cols = [c[~again] for c in cols]
            if giant is not None:
                on = token == giant[0]
                yield told(np.full(on.sum(), giant[1]), np.full(on.sum(), giant[2]), ref[on], n[on])
                token, salt, ref, n, reach = cols = [c[~on] for c in cols]
                if len(token):
                    giant = None
            if not len(token):
                rest = cols
                continue
            last = int(np.searchsorted(token, token[-1]))
            rest = [c[last:] for c in cols]
            if len(rest[0]) > most:
                giant = (rest[0][0], rest[2][0], rest[3][0])
                yield told(np.full(len(rest[0]), giant[1]), np.full(len(rest[0]), giant[2]), rest[2], rest[3])
                rest = [c[:0] for c in rest]
            x, y = _pairs_of_run(*(c[:last] for c in cols), few) if last else ([], [])
            if len(x):
                yield told(ref[x], n[x], ref[y], n[y])
        x, y = _pairs_of_run(*rest, few) if len(rest[0]) else ([], [])
        if len(x):
            yield told(rest[2][x], rest[3][x], rest[2][y], rest[3][y])

    sorted_ = prefixes.repartition("token", "salt").sortWithinPartitions("token", "salt", "info", "ref")
    return sorted_.mapInArrow(run, "lead long, lead_n long, token long, ref long, n long, reach long").distinct()


def _hot_pieces(hot: DataFrame) -> DataFrame:
    """(token, n, lead) of shingles that are dealt over tasks: where a set of ``n`` belongs.  The classes of
    a shingle are summed by set size first; sizes are cut where no smaller set reaches on."""
    sizes = hot.groupBy("token", "n").agg(F.max("reach").alias("far"), F.min("ref").alias("least"), F.count("*").alias("k"))
    by = Window.partitionBy("token").orderBy("n")  # a row for each size of a set
    before = F.max("far").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = sizes.withColumn("new", (before.isNull() | (F.col("n") > before)).cast("int")).withColumn("piece", F.sum("new").over(by))
    own = Window.partitionBy("token", "piece")
    return cut.select("token", "n", F.first("least").over(own.orderBy("n")).alias("lead"), F.sum("k").over(own).alias("all")).where("all > 1").drop("all")


def _cells(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` (with n) with ``chunk``: within ``by`` they are cut by n into chunks of about CHUNK rows and
    CHUNK_TOKENS tokens; an n that holds more is dealt by hash over chunks of its own."""
    sums = rows.groupBy(*by, "n").agg(F.count("*").alias("_m"))
    before = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)  # a row for each size of a set
    cell = F.floor(F.coalesce(F.sum("_m").over(before), F.lit(0)) / CHUNK) + F.floor(F.coalesce(F.sum(F.col("_m") * F.col("n")).over(before), F.lit(0)) / CHUNK_TOKENS)
    deal = F.greatest(F.ceil(F.col("_m") / CHUNK), F.ceil(F.col("_m") * F.col("n") / CHUNK_TOKENS))
    placed = sums.select(*by, "n", (4 * cell).alias("_cell"), deal.alias("_deal"))
    # what comes after a dealt size lies 4 (deal - 1) further at least
    chunk = F.col("_cell") + F.when(F.col("_deal") > 1, 1 + F.pmod(F.xxhash64("ref"), F.col("_deal"))).otherwise(0)
    return rows.join(placed, [*by, "n"]).withColumn("chunk", chunk).drop("_cell", "_deal")


def _blocks(members: DataFrame) -> DataFrame:
    """(lead, chunk, chunks, ref, n), the leader in every chunk of its block."""
    hot = members.where("token is not null").select("token", "ref", "n", "reach")
    cold = members.where("lead is not null")
    # hot counters are shared by many tokens, so nothing bounds their number
    pieces = _common.written(_hot_pieces(hot), "hot")
    few = pieces.limit(HOT_FEW + 1).count() <= HOT_FEW
    warm = hot.join(F.broadcast(pieces) if few else pieces, ["token", "n"]).select("lead", "ref", "n")
    rows = cold.select("lead", "ref", "n").unionByName(cold.select("lead", F.col("lead").alias("ref"), F.col("lead_n").alias("n"))).unionByName(warm).distinct()
    rows = _common.written(rows, "rows")
    sizes = rows.groupBy("lead").agg(F.count("*").alias("_m"), F.sum("n").alias("_t"))
    large = sizes.where((F.col("_m") > CHUNK) | (F.col("_t") > CHUNK_TOKENS)).select("lead")
    small = rows.join(large, "lead", "left_anti").select("lead", F.lit(0).cast("long").alias("chunk"), F.lit(1).alias("chunks"), "ref", "n")
    dealt = _cells(rows.join(large, "lead", "left_semi"), "lead").select("lead", "chunk", F.lit(2).alias("chunks"), "ref", "n")
    leaders = dealt.where("ref = lead").select("lead", "ref", "n", F.col("chunk").alias("_own"))
    copies = dealt.select("lead", "chunk").distinct().join(leaders, "lead").where("chunk <> _own").select("lead", "chunk", F.lit(2).alias("chunks"), "ref", "n")
    return small.unionByName(dealt).unionByName(copies)


def _filter_bits(refs: DataFrame) -> bytes:
    """FILTER_BITS bits, whatever the input; parts of the tasks' filters are put together by executors."""
    width = FILTER_BITS // 8 // FILTER_PARTS

    def own(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))
        rows = bits.reshape(FILTER_PARTS, width)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], ["part", "bits"])

    def put_together(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(bits, np.uint8)
                total[part] = total[part] | got if part in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "bits"])

    out = np.zeros((FILTER_PARTS, width), np.uint8)
    for r in refs.mapInArrow(own, "part int, bits binary").repartition("part").mapInArrow(put_together, "part int, bits binary").collect():
        out[r.part] |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _sets(docs: DataFrame, refs: DataFrame, seed: int) -> DataFrame:
    """(ref, text) of the classes in ``refs``, once a class and task; the fixed filter lets few others by."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(refs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(shared.value, np.uint8), set()
        for batch in _common.slices(batches, 1_000_000):
            texts = batch.column(0).to_pylist()
            keep, refs = [], []
            for i, s in enumerate(shingle_sets(texts)):
                if len(s):
                    ref = _ref(s, seed)
                    at = ref % (1 << 64) % FILTER_BITS
                    if ref not in seen and bits[at >> 3] >> (at & 7) & 1:
                        seen.add(ref)
                        keep.append(i)
                        refs.append(ref)
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array([texts[i] for i in keep], pa.string())], ["ref", "text"])

    return docs.select("text").mapInArrow(run, "ref long, text string")


def _groups(batches: Iterator[pa.RecordBatch], keys: int, same: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``keys`` columns of sorted batches, one row for each value of the next
    ``same`` columns (a class comes from as many tasks as hold it)."""
    key, rows = None, {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, list(rows.values())
                key, rows = row[:keys], {}
            rows.setdefault(row[keys : keys + same], row[keys:])
    if rows:
        yield key, list(rows.values())


def _link_rows(pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for part in _common.chunked(pairs, 10_000):
        yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in part], pa.int64()), pa.array([min(p) for p in part], pa.int64())], ["u", "v"])


def _few(rows: DataFrame) -> bool:
    return rows.limit(ROWS_FEW + 1).count() <= ROWS_FEW


def _within_chunks(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    def run(batches):
        def pairs():
            for (lead, _), rows in _groups(batches, 2, 1):
                by = dict(rows)
                refs = list(by)
                if len(refs) > 1:
                    sets = shingle_sets([by[r] for r in refs])
                    for i, j in chunk_links(sets, refs.index(lead)):
                        yield refs[i], refs[j]

        yield from _link_rows(pairs())

    # with few memberships the texts are shuffled once, to their chunks, not to their classes first
    members = blocks.select("lead", "chunk", "ref")
    members = F.broadcast(members) if _few(members) else members
    rows = texts.join(members, "ref").select("lead", "chunk", "ref", "text")
    return rows.repartition("lead", "chunk").sortWithinPartitions("lead", "chunk").mapInArrow(run, "u long, v long")


def _across_chunks(blocks: DataFrame, roots: DataFrame, docs: DataFrame, seed: int) -> DataFrame:
    """Links between chunks: blocks are cut anew by set size, large components into chunks of their own, the
    others together; a chunk of one component only meets chunks with others."""
    rows = blocks.where("chunks > 1").select("lead", "ref", "n").distinct().join(roots, "ref", "left").select("lead", "ref", "n", F.coalesce("root", "ref").alias("root"))
    rows = _common.written(rows, "rooted")
    parts = rows.groupBy("lead", "root").agg(F.count("*").alias("m"), F.sum("n").alias("t")).withColumn("alone", (F.col("m") >= CHUNK) | (F.col("t") >= CHUNK_TOKENS))
    many = parts.groupBy("lead").count().where("count > 1").select("lead")
    parts = parts.join(many, "lead", "left_semi").select("lead", "root", F.when(F.col("alone"), F.col("root")).alias("own"))
    dealt = rows.join(parts, ["lead", "root"]).withColumn("group", F.xxhash64("lead", "own", F.lit(7)))
    dealt = _common.written(_cells(dealt, "group").select("lead", "ref", "n", "root", "own", F.xxhash64("group", "chunk").alias("id")), "rechunked")
    named = dealt.groupBy("lead", "own", "id").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = named.alias("a"), named.alias("b")
    fits = (F.col("a.id") <= F.col("b.id")) & ((F.col("a.id") != F.col("b.id")) | F.col("a.own").isNull()) & ~F.coalesce(F.col("a.own") == F.col("b.own"), F.lit(False)) & (OF * F.col("a.high") >= SHARE * F.col("b.low")) & (OF * F.col("b.high") >= SHARE * F.col("a.low"))
    pairs = a.join(b, F.col("a.lead") == F.col("b.lead")).where(fits).select(F.col("a.lead").alias("lead"), F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    members = dealt.select("id", "ref", "root")
    left = pairs.join(members, F.col("x") == F.col("id")).select("x", "y", F.lit(0).alias("side"), "ref", "root")
    right = pairs.where("x != y").join(members, F.col("y") == F.col("id")).select("x", "y", F.lit(1).alias("side"), "ref", "root")
    rows = left.unionByName(right)

    def run(batches):
        def found():
            for (x, y), group in _groups(batches, 2, 2):
                sides = [{ref: (root, text) for side, ref, root, text in group if side == k} for k in (0, 1)]
                if x == y:
                    sides[1] = sides[0]
                number: dict[int, int] = {}
                refs = [list(s) for s in sides]
                of = [[number.setdefault(s[r][0], len(number)) for r in s] for s in sides]
                if refs[0] and refs[1] and len(number) > 1:
                    sets = [shingle_sets([s[r][1] for r in s]) for s in sides]
                    for i, j in cross_links(sets[0], of[0], sets[1], of[1]):
                        yield refs[0][i], refs[1][j]

        yield from _link_rows(found())

    # written, since a join of the union of both sides would scan the table once for each
    texts = _common.written(_sets(docs, rows.select("ref").distinct(), seed), "texts")
    return rows.join(texts, "ref").select("x", "y", "side", "ref", "root", "text").repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(ref, root) of every node of ``links`` (u, v): the least node that it reaches."""
    edges = _common.written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        got = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if got == state or got["n"] == 0:
            return edges.select(F.col("u").alias("ref"), F.col("v").alias("root"))
        state, before = got, edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _common.hot_join(both, least, "u", 2 * got["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = _common.written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _common.hot_join(large, least, "u", 2 * got["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = _common.written(small, "stars")
        _common.discard(before, large)


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every row (doc_id, tag, n, ref); and of every class (ref, component, first): the least doc_id of
    its component, and the component's first row as (nameless, doc_id, tag, copies)."""
    docs = docs.select("doc_id", "text")
    for seed in range(64):
        scanned = _common.written(_scan(docs, seed), "scan")
        rows = scanned.where("part is null")
        # rows of equal doc_id and text are copies; they are summed before a class, which may hold a third of all rows
        copies = rows.where("ref is not null").groupBy("ref", "also", "doc_id", "tag").agg(F.count("*").alias("copies"))
        first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tag", "copies")
        classes = _common.written(copies.groupBy("ref").agg((F.min("also") != F.max("also")).alias("torn"), F.min(first).alias("first")), "classes")
        if classes.where("torn").isEmpty():
            break
    else:
        raise RuntimeError("sets of equal digests under every seed")
    n = rows.count()
    sketch = _sketch(scanned.where("part is not null").select("part", "counts"))
    members = _common.written(_memberships(_prefixes(docs, sketch, n, seed)), "members")
    blocks = _common.written(_blocks(members), "blocks")
    _common.discard(members)
    links = _common.written(_within_chunks(blocks, _sets(docs, blocks.select("ref").distinct(), seed)), "within")
    roots = components(links)
    if not blocks.where("chunks > 1").isEmpty():
        more = _across_chunks(blocks, roots, docs, seed)
        roots = components(roots.select(F.col("ref").alias("u"), F.col("root").alias("v")).unionByName(more))
    rooted = _common.written(classes.select("ref", "first").join(roots, "ref", "left").select("ref", F.coalesce("root", "ref").alias("root"), "first"), "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("_f"))
    placed = _common.hot_join(rooted.select("ref", "root"), firsts, "root", n).select("ref", F.col("_f.doc_id").alias("component"), F.col("_f").alias("first"))
    placed = _common.written(placed, "placed")
    _common.discard(blocks, links, classes, rooted)
    return rows.select("doc_id", "tag", "n", "ref"), placed


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows, placed = _placed(docs)
    found = _common.hot_join(rows.drop("tag"), placed.select("ref", "component"), "ref", rows.count())
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("ref").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that of its least doc_id (a null one comes last; of several texts under
    that doc_id the least hash decides; of rows equal in doc_id and text any one stays).  Rows without words
    are linked with nothing and all stay."""
    rows, placed = _placed(docs)
    kept = placed.select("first").distinct().select("first.*").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_of"), "copies")
    keys = rows.where("ref is not null").select("doc_id", "tag").distinct()
    once = F.col("copies") == 1
    # texts that go, or of which one copy stays
    other = keys.join(kept.where(once), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_of")), "left_anti")
    other = _common.written(other.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_of")), "other")
    more = _common.written(kept.where(~once), "more")
    tag = _common.free_name(docs, "_tag")
    tagged = docs.withColumn(tag, F.xxhash64("text"))
    worded = F.coalesce(tagged["text"], F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = lambda df: tagged["doc_id"].eqNullSafe(df["_id"]) & (tagged[tag] == df["_of"])
    if _few(other):  # no text is shuffled
        out = tagged.join(F.broadcast(other), same(other) & worded, "left_anti").select(docs.columns)
    else:
        alone = kept.where(once)
        out = tagged.where(~worded).select(docs.columns).unionByName(tagged.where(worded).join(alone, same(alone), "left_semi").select(docs.columns))
    if more.isEmpty():
        return out
    few = F.broadcast(more) if _few(more) else more
    return out.unionByName(tagged.where(worded).join(few, same(more), "left_semi").dropDuplicates(["doc_id", tag]).select(docs.columns))
