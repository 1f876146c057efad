"""Product codes of vectors by exact Lloyd rounds over two trees.

Components become integers floor(256 * x); a vector is cut into 16 equal consecutive parts, and
each part position has a codebook of 64 entries that two rounds of Lloyd's method move.

Vectors are stored once in blocks. A block keeps, for each part position, the order of its parts
in a balanced tree (halved along the widest axis), and its nodes' boxes, counts and sums follow
from that order. A round builds the same kind of tree over the entries and goes down both from
node pair to node pair, level by level, on whole arrays: the least distance between two boxes
against the greatest distance to another drops pairs, and, once entries stand alone, so does an
entry that lies farther than another from every corner of the box. A node left with one entry is
assigned whole, by its cached count and sum; parts of leaves with several entries left are
compared in integers. All bounds are integers, so every decision is exact and ties go to the
lower index. A task sends the sums of its entries (``64 x width`` integers in limbs of 32 bits),
Spark adds them up, and the driver divides: codebooks are all it ever sees.

Defined cases: vectors that are NULL or hold NULL or non-finite components are dropped; widths
that differ or are no multiple of 16 count as padded with zeros to the longest, rounded up;
vectors of components beyond 64-bit squares are computed in Python's integers (an error beyond a
long is the largest long); the first codebook takes rows by ``vec_id`` (NULL last) and then by
vector, fewer than 64 rows give fewer entries; rows with equal or NULL ids have a code each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from math import floor, isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import broadcast_if_small, map_rows, store

PARTS = 16
ENTRIES = 64
SCALE = 256
ROUNDS = 2
LEAF = 16
BLOCK_VALUES = 1 << 18
LIMB = 32
LARGEST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integers(vectors: list[list[float]], width: int) -> np.ndarray:
    """floor(256 * x) of vectors padded with zeros: 64-bit, or Python's integers where they are wide."""
    x = np.zeros((len(vectors), width))
    for row, v in zip(x, vectors, strict=True):
        row[: len(v)] = v
    if not x.size or np.abs(x).max() < 1 << 40:
        return np.floor(SCALE * x).astype(np.int64)
    whole = [[int(c) * SCALE if abs(c) >= 1 << 53 else floor(c * SCALE) for c in row] for row in x.tolist()]
    return np.array(whole, dtype=object)


def _narrow(points: np.ndarray, entries: np.ndarray) -> bool:
    """Whether all bounds and squared distances fit 64-bit integers."""
    if points.dtype == object or entries.dtype == object:
        return False
    limit = isqrt((1 << 59) // max(points.shape[-1], 1))
    return max((int(np.abs(a).max()) for a in (points, entries) if a.size), default=0) <= limit


def depth_of(n: int, leaf: int) -> int:
    """Levels below the root of a tree over n points whose leaves hold at most ``leaf``."""
    return max(0, -(-n // leaf) - 1).bit_length()


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """Positions of the points in the leaves' order; those from ``len(points)`` on are padding."""
    n = len(points)
    depth = depth_of(n, leaf)
    size = -(-n // (1 << depth)) * (1 << depth)
    padded = np.concatenate([points, np.repeat(points[-1:], size - n, axis=0)])
    order = np.arange(size)[None, :]
    for _ in range(depth):
        own = padded[order]
        axis = (own.max(axis=1) - own.min(axis=1)).argmax(axis=1)
        keys = np.take_along_axis(own, axis[:, None, None], axis=2)[:, :, 0]
        order = np.take_along_axis(order, keys.argsort(axis=1, kind="stable"), axis=1)
        order = order.reshape(2 * len(order), -1)
    return order.ravel()


class Tree:
    """Boxes, counts and sums of the nodes of a tree, level by level from the root."""

    def __init__(self, points: np.ndarray, order: np.ndarray, leaf: int) -> None:
        n = len(points)
        self.depth = depth_of(n, leaf)
        self.order, self.real = order, order < n
        self.points = points[np.minimum(order, n - 1)]
        leaves = 1 << self.depth
        own = self.points.reshape(leaves, -1, points.shape[1])
        real = self.real.reshape(leaves, -1)
        level = (own.min(axis=1), own.max(axis=1), real.sum(axis=1), (own * real[:, :, None]).sum(axis=1))
        levels = [level]
        for _ in range(self.depth):
            low, high, count, total = levels[-1]
            levels.append(
                (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), count[::2] + count[1::2], total[::2] + total[1::2])
            )
        self.levels = levels[::-1]


class Assignment:
    """Which entry each part of a block goes to, with the counts and sums of the entries."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None, entries: np.ndarray) -> None:
        self.counts = np.zeros(len(entries), np.int64)
        self.sums = np.zeros_like(entries)
        self.computed = 0
        if order is not None and _narrow(points, entries):
            self._go_down(Tree(points, order, LEAF), entries, len(points))
        else:
            self._compare_all(points.astype(object), entries.astype(object))

    def _compare_all(self, points: np.ndarray, entries: np.ndarray) -> None:
        self.sums = self.sums.astype(object)
        self.code = np.zeros(len(points), np.int64)
        for at, point in enumerate(points):
            away = ((entries - point) ** 2).sum(axis=1).tolist()
            near = away.index(min(away))
            self.code[at] = near
            self.counts[near] += 1
            self.sums[near] += point

    def _go_down(self, parts: Tree, entries: np.ndarray, n: int) -> None:
        book = Tree(entries, tree_order(entries, 1), 1)
        placed = np.full(len(parts.order), -1)
        q, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
        at, to = 0, 0
        while True:
            q, e = self._near(parts.levels[at], book.levels[to], q, e)
            if to == book.depth:
                real = book.real[e]
                q, e = q[real], e[real]
                q, e = self._beaten(parts.levels[at], book.points, q, e)
                alone = np.bincount(q, minlength=1 << at)[q] == 1
                self._assign(parts.levels[at], placed.reshape(1 << at, -1), q[alone], book.order[e[alone]])
                q, e = q[~alone], e[~alone]
                if at == parts.depth or not len(q):
                    break
            if to < book.depth:
                q, e, to = np.repeat(q, 2), (2 * e[:, None] + [0, 1]).ravel(), to + 1
            if at < parts.depth:
                q, e, at = (2 * q[:, None] + [0, 1]).ravel(), np.repeat(e, 2), at + 1
        if len(q):
            self._leaves(parts, entries, placed, q, book.order[e])
        self.code = np.empty(n, np.int64)
        self.code[parts.order[parts.real]] = placed[parts.real]

    @staticmethod
    def _near(level: tuple, book: tuple, q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that are not farther apart than the node is, at most, from another of its pairs."""
        low, high, *_ = level
        from_, until, *_ = book
        a, b = from_[e] - high[q], low[q] - until[e]
        least = (np.maximum(np.maximum(a, b), 0) ** 2).sum(axis=1)
        most = (np.maximum(until[e] - low[q], high[q] - from_[e]) ** 2).sum(axis=1)
        best = np.full(len(low), LARGEST)
        np.minimum.at(best, q, most)
        keep = least <= best[q]
        return q[keep], e[keep]

    @staticmethod
    def _beaten(level: tuple, points: np.ndarray, q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose entry is nearer than the node's central one somewhere in the node's box."""
        low, high, *_ = level
        middle = ((2 * points[e] - low[q] - high[q]) ** 2).sum(axis=1)
        rank = np.lexsort((middle, q))
        first = np.ones(len(q), bool)
        first[1:] = q[rank][1:] != q[rank][:-1]
        central = np.zeros(len(low), np.int64)
        central[q[rank][first]] = e[rank][first]
        mine, other = points[e], points[central[q]]
        corner = np.where(mine > other, high[q], low[q])
        ahead = (other**2 - mine**2 + 2 * (mine - other) * corner).sum(axis=1)
        keep = ahead >= 0
        return q[keep], e[keep]

    def _assign(self, level: tuple, placed: np.ndarray, q: np.ndarray, entry: np.ndarray) -> None:
        _, _, count, total = level
        np.add.at(self.counts, entry, count[q])
        np.add.at(self.sums, entry, total[q])
        placed[q] = entry[:, None]

    def _leaves(self, parts: Tree, entries: np.ndarray, placed: np.ndarray, q: np.ndarray, entry: np.ndarray) -> None:
        """Exact comparison of the parts of leaves with the entries left to them."""
        rank = np.lexsort((entry, q))
        q, entry = q[rank], entry[rank]
        leaves = 1 << parts.depth
        own = parts.points.reshape(leaves, -1, entries.shape[1])
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        away = ((own[q] - entries[entry][:, None, :]) ** 2).sum(axis=2)
        self.computed += away.size
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(q))))
        least = np.minimum.reduceat(away, starts, axis=0)
        ties = np.where(away == least[group], entry[:, None], len(entries))
        near = np.minimum.reduceat(ties, starts, axis=0)
        leaf = q[starts]
        placed.reshape(leaves, -1)[leaf] = near
        real = parts.real.reshape(leaves, -1)[leaf]
        np.add.at(self.counts, near[real], 1)
        np.add.at(self.sums, near[real], own[leaf][real])


def _blocks(width: int):
    """Vectors in blocks: rows, ids, labels, integers, and the tree order of every part."""
    size = max(1, BLOCK_VALUES // max(width, 1))

    def pack(vectors: list[tuple]) -> tuple:
        ids, labels, given = zip(*vectors, strict=True)
        x = integers(given, width)
        wide = x.dtype == object
        order = b"" if wide or not width else np.stack([tree_order(p, LEAF) for p in np.split(x, PARTS, axis=1)]).astype("<i4").tobytes()
        values = None if wide else x.astype("<i8").tobytes()
        return list(ids), list(labels), values, [str(c) for c in x.ravel()] if wide else None, order

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) == size:
                yield pack(held)
                held = []
        if held:
            yield pack(held)

    return run


def _parts_of(block: tuple, width: int) -> tuple[list, list, np.ndarray, np.ndarray]:
    ids, labels, values, wide, order = block
    if wide is not None:
        x = np.array([int(c) for c in wide], dtype=object).reshape(len(ids), width)
    else:
        x = np.frombuffer(values, "<i8").reshape(len(ids), width)
    # Blocks of wide components and of vectors without any have no trees.
    return ids, labels, x, np.frombuffer(order, "<i4").reshape(PARTS, -1) if order else [None] * PARTS


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """An integer as signed digits of 32 bits, the last one with the sign."""
    at = 0
    while not -(1 << LIMB) < total < 1 << LIMB:
        yield at, total & ((1 << LIMB) - 1)
        total >>= LIMB
        at += 1
    yield at, total


def _codebooks(rows: list[list[int]], n: int, width: int) -> list[np.ndarray]:
    whole = np.array(rows, dtype=object).reshape(n, width)
    if not whole.size or max(abs(c) for c in whole.ravel().tolist()) < 1 << 60:
        whole = whole.astype(np.int64)
    return np.split(whole, PARTS, axis=1)


def lloyd_round(blocks: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after every part went to its nearest entry; unused entries stay."""
    n, part_width = books[0].shape

    def sums(rows: Iterable[tuple]) -> Iterator[tuple]:
        counts = np.zeros((PARTS, n), np.int64)
        totals = np.zeros((PARTS, n, part_width), object)
        for block in rows:
            _, _, x, order = _parts_of(block, width)
            for p, part in enumerate(np.split(x, PARTS, axis=1)):
                found = Assignment(part, order[p], books[p])
                counts[p] += found.counts
                totals[p] += found.sums.astype(object)
        for p, e in zip(*np.nonzero(counts), strict=True):
            yield int(p), int(e), -1, 0, int(counts[p, e])
            for at, total in enumerate(totals[p, e]):
                for limb, digits in _limbs(int(total)):
                    yield int(p), int(e), at, limb, digits

    partial = map_rows(blocks, sums, "part int, entry int, at int, limb int, digits long")
    counts: dict[tuple, int] = {}
    totals: dict[tuple, int] = {}
    # At most (1 + width / 16) sums for each of 16 x 64 entries, whatever the table.
    for part, entry, at, limb, digits in partial.groupBy("part", "entry", "at", "limb").agg(F.sum("digits")).collect():
        if at < 0:
            counts[part, entry] = digits
        else:
            totals[part, entry, at] = totals.get((part, entry, at), 0) + (int(digits) << (LIMB * limb))
    moved = [b.astype(object) for b in books]
    for (part, entry, at), total in totals.items():
        moved[part][entry, at] = total // counts[part, entry]
    return _codebooks(np.concatenate(moved, axis=1).tolist(), n, width)


def encode_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS
) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every vector that is kept."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    kept = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), x.alias("x"))
    types = dict(kept.dtypes)
    width = kept.agg(F.max(F.size("x"))).first()[0]
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).select("x").collect()
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    if not first:
        empty = kept.sparkSession.createDataFrame([], schema)
        return empty.select("*", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = -(-width // PARTS) * PARTS
    books = _codebooks(integers([r["x"] for r in first], width).tolist(), len(first), width)
    block = f"ids array<{types['vec_id']}>, labels array<{types['label']}>, x binary, wide array<string>, ordered binary"
    blocks = store(map_rows(kept, _blocks(width), block, 1), "vector-blocks")
    for _ in range(rounds):
        books = lloyd_round(blocks, books, width)
    last = books

    def encode(rows: Iterable[tuple]) -> Iterator[tuple]:
        for held in rows:
            ids, labels, x, order = _parts_of(held, width)
            codes = np.zeros((len(ids), PARTS), np.uint8)
            error = np.zeros(len(ids), object)
            for p, part in enumerate(np.split(x, PARTS, axis=1)):
                found = Assignment(part, order[p], last[p])
                codes[:, p] = found.code
                apart = part - last[p][found.code] if _narrow(part, last[p]) else part.astype(object) - last[p].astype(object)[found.code]
                error += (apart**2).sum(axis=1).astype(object)
            for row in zip(ids, labels, codes, error.tolist(), strict=True):
                yield row[0], row[1], row[2].tobytes().hex(), min(int(row[3]), LARGEST)

    coded = store(map_rows(blocks, encode, schema), "vector-codes")
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.least(wide, F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    digest = sha256(",".join(str(c) for b in last for c in b.ravel().tolist()).encode()).hexdigest()
    joined = coded.join(broadcast_if_small(by_label), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
