"""Exact k highest inner products by best-first search of an M-tree.

Components are floor(1024 * x). One further coordinate, sqrt(greatest norm**2 - norm**2),
makes all indexed vectors equally long, so that a smaller Euclidean distance is a higher inner
product and metric bounds apply. The tree has three levels: routing vectors fitted on a
bounded sample (``SAMPLE`` vectors), the subtrees of vectors nearest to one, and pages of at
most ``PAGE`` vectors. A page keeps its own centre, covering radius and distance to the
routing vector, and each entry its distance to the centre. The search goes through pages in
order of their bounds, skips a page by its stored distance to the parent before any distance
is computed, and skips entries by their stored distances. Every vector is indexed and the
result is exact; scores are 64-bit integers.

A query first searches the subtree of the nearest routing vector; then only the subtrees whose
covering radius lets them reach its k-th score. Queries meet a subtree in blocks. Equal
vectors are one entry with its k + 1 smallest ids, as no others can be among the k best.

Vectors of components beyond 2**28 are no part of the tree, whose bounds are floating-point
numbers: pairs that hold one are scored in Python's integers, queries and candidates in blocks.

Defined cases: NULL vectors and vectors with NULL or non-finite components take no part;
shorter vectors count as padded with zeros (an empty one scores 0); a score beyond a long is
the nearest long; rows with a NULL id take no part; an id that repeats
is one candidate for each of its different vectors and one query for each; an empty table gives
no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from math import ceil, floor, isfinite, sqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.llm.common import broadcast_if_small, cut, map_rows, store

K = 10
EVERY = 100
SCALE = 1024
LARGEST = 1 << 28
SAMPLE = 4096
ROUTES = 1024
SUBTREE = 2048
PAGE = 64
QUERY_BLOCK = 2048
HELD_VECTORS = 50_000
LONG_MAX = (1 << 63) - 1


def whole(embedding: list | None) -> list[int] | None:
    """A vector's components as integers floor(SCALE * x); None if it takes no part."""
    if embedding is None or any(x is None or not isfinite(x) for x in embedding):
        return None
    return [int(x) * SCALE if abs(x) >= 1 << 53 else floor(x * SCALE) for x in embedding]


def quantised(embedding: list | None) -> bytes | None:
    """The components as little-endian 32-bit integers without zeros at the end; None for a
    vector that takes no part or is too wide for them."""
    if embedding is None or None in embedding:
        return None
    x = np.asarray(embedding, np.float64)
    if not np.isfinite(x).all():
        return None
    if len(x) and np.abs(SCALE * x).max() >= LARGEST:
        return None
    return np.trim_zeros(np.floor(SCALE * x).astype("<i4"), "b").tobytes()


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        own = np.frombuffer(v, "<i4")
        row[: len(own)] = own
    return out


def lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    """Vectors with the coordinate that gives them all the same length."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(norm2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two matrices."""
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def routing_vectors(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """``n`` centres of a sample, by a few rounds of k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:n]].copy()
    for _ in range(4):
        near = distances(sample, centres).argmin(axis=1)
        for c in np.unique(near):
            centres[c] = sample[near == c].mean(axis=0)
    return centres


def pages_of(points: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the points in pages of at most PAGE, split by two far members at a time."""
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= PAGE:
            yield at
            continue
        own = points[at]
        a = own[distances(own, own.mean(axis=0)[None, :])[:, 0].argmax()]
        to_a = distances(own, a[None, :])[:, 0]
        left = to_a <= distances(own, own[to_a.argmax()][None, :])[:, 0]
        if left.all() or not left.any():
            left = np.arange(len(at)) < len(at) // 2
        todo += [at[left], at[~left]]


class Subtree:
    """The pages of one subtree, and the search for the best entries of a query."""

    def __init__(self, centre: np.ndarray, pages: list[tuple], width: int, norm2: float) -> None:
        self.centre, self.norm2 = centre, norm2
        self.centres = np.stack([np.frombuffer(p[0], "<f8") for p in pages])
        self.radius, self.to_parent = np.array([p[1] for p in pages]), np.array([p[2] for p in pages])
        self.entries = []
        for _, _, _, vectors, away, ids in pages:
            x = matrix(vectors, width)
            self.entries.append((x, np.frombuffer(away, "<f8"), ids))
        self.computed = 0

    def search(self, q: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """Up to ``k`` best (score, id), none that cannot be among the ``k`` best.

        ``least`` is a score that the k-th best is known to reach.
        """
        q2 = float((q.astype(np.float64) ** 2).sum())
        point = np.concatenate([q.astype(np.float64), [0.0]])
        slack = 0.5 + 1e-9 * (q2 + self.norm2)
        best: list[tuple[int, int]] = []

        def reach() -> float:
            """Distance beyond which no entry can matter."""
            floor = best[k - 1][0] if len(best) >= k else None
            floor = least if floor is None or least is not None and least > floor else floor
            return np.inf if floor is None else sqrt(max(q2 + self.norm2 - 2 * (floor - slack), 0))

        limit = reach()
        to_parent = float(np.sqrt(((point - self.centre) ** 2).sum()))
        open_pages = np.flatnonzero(np.abs(to_parent - self.to_parent) - self.radius <= limit)
        if not len(open_pages):
            return best
        away = distances(point[None, :], self.centres[open_pages])[0]
        self.computed += len(open_pages)
        bound = away - self.radius[open_pages]
        for i in np.argsort(bound, kind="stable"):
            if bound[i] - slack * 1e-6 > limit:
                break
            x, to_centre, ids = self.entries[open_pages[i]]
            near = np.flatnonzero(np.abs(away[i] - to_centre) <= limit + 1e-6 * (1 + limit if limit < np.inf else 1))
            if not len(near):
                continue
            self.computed += len(near)
            score = x[near] @ q
            floor = best[k - 1][0] if len(best) >= k else -np.inf
            best += [(s, i) for s, j in zip(score.tolist(), near.tolist(), strict=True) if s >= floor for i in ids[j]]
            best = sorted(best, key=lambda e: (-e[0], e[1]))[:k]
            limit = reach()
        return best


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of every query (ids divisible by
    ``every``) among all other rows, ties to the smaller id."""
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    found = _tree_search(slim, k, every)
    too_wide = F.exists("v", lambda x: F.abs(x.cast("double")) * SCALE >= LARGEST)
    wide = slim.where(too_wide)
    if not wide.isEmpty():
        asked = slim.where(F.col("id") % every == 0)
        found = found.unionByName(_plain_search(asked, wide, k)).unionByName(_plain_search(asked.where(too_wide), slim.where(~too_wide), k))
    in_order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _plain_search(asked: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The best candidates of each query in each block of candidates, in exact integers."""
    q_blocks, c_blocks = (max(1, ceil(df.count() / QUERY_BLOCK)) for df in (asked, candidates))

    def spread(df: DataFrame, own: str, n_own: int, other: str, n_other: int, asks: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", "v"), F.lit(n_own)).cast("int").alias(own)
        return df.select(mine, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other), F.lit(asks).alias("asks"), "id", "v").select("qb", "cb", "asks", "id", "v")

    both = spread(asked, "qb", q_blocks, "cb", c_blocks, True).unionByName(spread(candidates, "cb", c_blocks, "qb", q_blocks, False))
    together = both.repartition("qb", "cb").sortWithinPartitions("qb", "cb", "asks", "id")

    def search(rows: Iterable[tuple]) -> Iterator[tuple]:
        for own in _groups(rows, 2):
            held = [(i, x) for _, _, asks, i, v in own if not asks and (x := whole(v)) is not None]
            for _, _, asks, i, v in own:
                if asks and (q := whole(v)) is not None:
                    scored = ((sum(a * b for a, b in zip(q, x, strict=False)), j) for j, x in held if j != i)
                    name = quantised(v)
                    name = b"wide" + blake2b(repr(q).encode(), digest_size=16).digest() if name is None else name
                    for score, j in heapq.nsmallest(k, ((-s, j) for s, j in scored)):
                        yield i, name, j, max(min(-score, LONG_MAX), -LONG_MAX - 1)

    return map_rows(together, search, "query_id long, query binary, vec_id long, score long")


def _tree_search(slim: DataFrame, k: int, every: int) -> DataFrame:
    """``query_id, query, vec_id, score`` with at least the ``k`` best of each query vector among
    the vectors that are not wide."""
    spark = slim.sparkSession
    keep = k + 1  # a query is itself among its best

    def distinct(rows: Iterable[tuple]) -> Iterator[tuple]:
        """Different vectors of a partition, each with its smallest ids and all query ids."""
        held: dict[bytes, tuple[set, list]] = {}
        for i, v in rows:
            key = quantised(v)
            if key is None:
                continue
            if key not in held and len(held) >= HELD_VECTORS:
                yield from ((x, sorted(a), b) for x, (a, b) in held.items())
                held = {}
            ids, queries = held.setdefault(key, (set(), []))
            ids.add(i)
            if len(ids) > keep:
                ids.remove(max(ids))
            if i % every == 0:
                queries.append(i)
                if len(queries) >= 1000:
                    yield key, [], list(queries)
                    queries.clear()
        yield from ((x, sorted(a), b) for x, (a, b) in held.items())

    seen = store(map_rows(slim, distinct, "vec binary, ids array<long>, queries array<long>", 1000), "vectors")
    queries = seen.select("vec", F.explode("queries").alias("query_id")).distinct()
    # A task gives at most k + 1 ids of a vector, so this list is bounded by the tasks.
    least_ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    entries = cut(seen.groupBy("vec").agg(least_ids.alias("ids")))

    def norms(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (v,) in rows:
            x = np.frombuffer(v, "<i4").astype(np.int64)
            yield len(x), int((x * x).sum())

    facts = map_rows(entries.select("vec"), norms, "width int, norm2 long").agg(
        F.count(F.lit(1)).alias("n"), F.max("width").alias("width"), F.max("norm2").alias("norm2")
    ).first()
    total, width, norm2 = facts["n"], facts["width"] or 0, float(facts["norm2"] or 0)
    sampled = [bytes(r["vec"]) for r in entries.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()]
    if not total:
        return spark.createDataFrame([], "query_id long, query binary, vec_id long, score long")
    routes = routing_vectors(lifted(matrix(sampled, width), norm2), min(ROUTES, ceil(sqrt(total)), len(sampled)))
    shared = spark.sparkContext.broadcast((routes, width, norm2))

    pages = _build(entries, shared)
    # One row per subtree: what a query needs to tell whether it must look inside.
    directory = pages.groupBy("cell", "chunk").agg(F.max("reach").alias("reach"), F.sum("entries").alias("entries")).collect()
    folders = spark.sparkContext.broadcast(sorted((r["cell"], r["chunk"], r["reach"]) for r in directory))

    def route(rows: Iterable[tuple], first: bool) -> Iterator[tuple]:
        routes, width, norm2 = shared.value
        cell = np.array([f[0] for f in folders.value])
        reach = np.array([f[2] for f in folders.value])
        for own in _chunks(rows, 256):
            q = matrix([r[0] for r in own], width).astype(np.float64)
            away = distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), routes)[:, cell]
            home = away.argmin(axis=1)
            for r, row, h, q2 in zip(own, away, home.tolist(), (q**2).sum(axis=1).tolist(), strict=True):
                if first:
                    visit = [h]
                elif r[1] is None:
                    visit = [i for i in range(len(cell)) if i != h]
                else:
                    limit = sqrt(max(q2 + norm2 - 2 * (r[1] - 0.5 - 1e-9 * (q2 + norm2)), 0))
                    visit = [i for i in np.flatnonzero(row - reach <= limit + 1e-6 * (1 + limit)).tolist() if i != h]
                for i in visit:
                    yield folders.value[i][0], folders.value[i][1], r[0], r[1]

    asked = cut(queries.select("vec").distinct())
    schema = "cell int, chunk int, vec binary, least long"
    home = map_rows(asked.select("vec", F.lit(None).cast("long").alias("least")), lambda rows: route(rows, True), schema)
    first = cut(_search(pages, home, shared, keep))
    in_order = Window.partitionBy("vec").orderBy(F.desc("score"), "id")
    bar = first.withColumn("at", F.row_number().over(in_order)).where(F.col("at") == keep).select("vec", F.col("score").alias("least"))
    rest = map_rows(asked.join(bar, "vec", "left").select("vec", "least"), lambda rows: route(rows, False), schema)
    found = first.unionByName(_search(pages, rest, shared, keep))
    best = cut(found.withColumn("at", F.row_number().over(in_order)).where(F.col("at") <= keep).select("vec", "id", "score"))
    # an id with several vectors is several candidates and several queries
    answers = queries.join(best, "vec").where("id <> query_id")
    return answers.select("query_id", F.col("vec").alias("query"), F.col("id").alias("vec_id"), "score")


def _chunks(rows: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _build(entries: DataFrame, shared) -> DataFrame:
    """The tree's pages: every entry goes to its nearest routing vector and there to a page."""

    def assign(rows: Iterable[tuple]) -> Iterator[tuple]:
        routes, width, norm2 = shared.value
        for own in _chunks(rows, 1024):
            away = distances(lifted(matrix([r[0] for r in own], width), norm2), routes)
            for r, cell in zip(own, away.argmin(axis=1).tolist(), strict=True):
                yield cell, r[0], r[1]

    placed = cut(map_rows(entries.select("vec", "ids"), assign, "cell int, vec binary, ids array<long>", 1000))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SUBTREE).alias("chunks"))
    split = placed.join(broadcast_if_small(cut(sizes)), "cell")
    split = split.withColumn("chunk", F.pmod(F.xxhash64("vec"), F.col("chunks")).cast("int"))
    ordered = split.select("cell", "chunk", "vec", "ids").repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "vec")

    def build(rows: Iterable[tuple]) -> Iterator[tuple]:
        routes, width, norm2 = shared.value
        for own in _groups(rows, 2):
            cell, chunk = own[0][:2]
            points = lifted(matrix([r[2] for r in own], width), norm2)
            centre = routes[cell]
            to_route = distances(points, centre[None, :])[:, 0]
            for n, at in enumerate(pages_of(points)):
                middle = points[at].mean(axis=0)
                away = distances(points[at], middle[None, :])[:, 0]
                parent = float(np.sqrt(((middle - centre) ** 2).sum()))
                yield (
                    cell, chunk, n, middle.astype("<f8").tobytes(), float(away.max()) + 1e-6 * (1 + norm2**0.5), parent,
                    [own[i][2] for i in at.tolist()], away.astype("<f8").tobytes(), [own[i][3] for i in at.tolist()],
                    float(to_route[at].max()) + 1e-6 * (1 + norm2**0.5), len(at),
                )

    schema = (
        "cell int, chunk int, page int, centre binary, radius double, to_parent double, vectors array<binary>, "
        "away binary, ids array<array<long>>, reach double, entries int"
    )
    return store(map_rows(ordered, build, schema, 100), "pages")


def _groups(rows: Iterable[tuple], width: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in rows:
        if held and held[0][:width] != row[:width]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _search(pages: DataFrame, asked: DataFrame, shared, keep: int) -> DataFrame:
    """``vec, score, id``: each query vector's best entries in each subtree it visits."""
    asked = cut(asked)
    blocks = cut(asked.groupBy("cell", "chunk").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks")))
    blocks = broadcast_if_small(blocks)
    none = F.lit(None)
    kept = ["centre", "radius", "to_parent", "vectors", "away", "ids"]
    trees = pages.join(blocks, ["cell", "chunk"]).withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    trees = trees.select("cell", "chunk", "block", "page", *kept, none.cast("binary").alias("vec"), none.cast("long").alias("least"))
    own = asked.join(blocks, ["cell", "chunk"]).withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))
    types = dict(pages.dtypes)
    own = own.select("cell", "chunk", "block", F.lit((1 << 31) - 1).alias("page"), *[none.cast(types[c]).alias(c) for c in kept], "vec", "least")
    together = trees.unionByName(own).repartition("cell", "chunk", "block").sortWithinPartitions("cell", "chunk", "block", "page")

    def search(rows: Iterable[tuple]) -> Iterator[tuple]:
        routes, width, norm2 = shared.value
        key, held, tree = None, [], None
        for row in rows:
            if row[:3] != key:
                key, held, tree = row[:3], [], None
            if row[10] is None:
                held.append(row[4:10])
                continue
            if tree is None:
                tree = Subtree(routes[key[0]], held, width, norm2)
            for score, i in tree.search(matrix([row[10]], width)[0], keep, row[11]):
                yield row[10], score, i

    return map_rows(together, search, "vec binary, score long, id long")
