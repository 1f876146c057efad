"""Similarity join of documents on word shingles by chosen paths.

Documents with the same set of five-word shingles are one class of copies, joined by its
representative. Every class has a MinHash signature of 128 values, so two sets agree in a
position with the probability of their Jaccard similarity. A run of the chosen-path join
splits the classes on sampled positions: a path picks a few of the positions by a hash of the
path (1 / similarity of them on average, at least one) and sends a class on along
(position, value). Buckets of at most ``LIMIT`` classes are compared by brute force, larger
ones are split again; what is still large after ``LEVELS`` splits is compared in pairs of
blocks. Runs are repeated until a pair at the threshold is found with probability
``TARGET_RECALL`` (more similar pairs more often).

The comparison in the buckets is of signatures, with a margin of four standard deviations;
it yields groups of possible links as trees, never all pairs. Within a group the exact
similarity of every two classes is computed from their shingle sets, block by block, and
counted; the connected components of the exact links are the result's classes.

Defined cases: NULL texts and texts without words have no links and are a class each; a text
of fewer than five words is one shingle of all its words; rows with the same id and shingles
are one document; rows with the same id and different texts are linked like different
documents; a NULL id counts as one id after all others; an empty table gives no rows; extra
columns of the input are ignored. Node names are 64-bit hashes of shingle sets: with n
different sets the odds that two coincide are about n * n / 3.7e19.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import exp, factorial, log, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import broadcast_if_small, cut, map_rows, store
from funnelworks.llm.components import connected_components
from funnelworks.llm.shingles import SHINGLE, SIMILARITY, mix, shingles, with_words

POSITIONS = 128
LIMIT = 256
LEVELS = 3
TARGET_RECALL = 0.999
# Exact comparison: classes and shingles of a block.
BLOCK_CLASSES = 128
BLOCK_SHINGLES = 1_000_000
LAST_ID = (1 << 63) - 1

_KEYS = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64))


def chance_of_finding(similarity: float, levels: int = LEVELS) -> float:
    """Least probability that one run puts a pair of the given similarity into one bucket.

    A branching process: a path has max(1, Poisson(1/similarity)) positions, each kept by
    both sets with the probability of their similarity.
    """
    rate, lost = 1 / similarity, 0.0
    for _ in range(levels):
        stay = 1 - similarity * (1 - lost)
        terms = [exp(-rate) * rate**c / factorial(c) * stay ** max(c, 1) for c in range(40)]
        lost = sum(terms)
    return 1 - lost


def runs_for(recall: float = TARGET_RECALL, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair at the threshold has been found with this probability."""
    return max(1, round(0.5 + log(1 - recall) / log(1 - chance_of_finding(similarity))))


def minima(shingle: np.ndarray) -> np.ndarray:
    """The 128 MinHash values of a shingle set, in 64 bits."""
    out = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for part in np.split(shingle, range(2048, len(shingle), 2048)):
        h = (part[:, None] ^ _KEYS[None, :]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        np.minimum(out, h.min(axis=0), out=out)
    return mix(out)


def signature(values: np.ndarray) -> np.ndarray:
    """What is kept of the MinHash values to compare them: 8 bits each."""
    return (values >> np.uint64(56)).astype(np.uint8)


def class_key(shingle: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell a shingle set."""
    two = mix(shingle ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(shingle + np.uint64(77)).sum(dtype=np.uint64)
    return tuple(int(x) for x in np.array(two, np.uint64).view(np.int64))


def chosen(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions each path picks: (index into ``paths``, position)."""
    draw = mix(paths[:, None] ^ _KEYS[None, ::-1])
    taken = draw < np.uint64(int(2**64 / (SIMILARITY * POSITIONS)))
    taken[np.arange(len(paths)), draw.argmin(axis=1)] = True
    return np.nonzero(taken)


def next_paths(paths: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of (path, signature) rows: (row, child path)."""
    at, position = chosen(paths)
    step = mix(position.astype(np.uint64) + np.uint64(1)) ^ signatures[at, position].astype(np.uint64)
    return at, mix(mix(paths[at]) + step).view(np.int64)


def first_paths(values: np.ndarray, runs: int) -> np.ndarray:
    """The paths of a set after the first split of every run, by its whole MinHash values.

    Their 64 bits keep sets apart that share nothing, however many there are.
    """
    start = mix(np.arange(runs, dtype=np.uint64) + np.uint64(0xC0FFEE))
    return next_paths(start, np.broadcast_to(values, (runs, POSITIONS)))[1]


def _tree(roots: np.ndarray, names: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of bounded degree that hold each group of equal roots together."""
    order = np.argsort(roots, kind="stable")
    for own in np.split(names[order], np.flatnonzero(np.diff(roots[order])) + 1):
        for i in range(1, len(own)):
            yield int(own[(i - 1) // 2]), int(own[i])


def _groups(alike: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric boolean matrix."""
    label = np.arange(len(alike))
    while True:
        new = np.where(alike, label[None, :], len(alike)).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


LEAST_AGREEING = int(POSITIONS * (SIMILARITY - 4 * sqrt(SIMILARITY * (1 - SIMILARITY) / POSITIONS)))


def may_link(signatures: np.ndarray) -> np.ndarray:
    """Which pairs of signatures may belong to sets that reach the similarity."""
    alike = np.empty((len(signatures), len(signatures)), bool)
    for at in range(0, len(signatures), 64):
        alike[at : at + 64] = (signatures[at : at + 64, None, :] == signatures[None, :, :]).sum(axis=2) >= LEAST_AGREEING
    np.fill_diagonal(alike, True)
    return alike


def possible_links(names: np.ndarray, signatures: np.ndarray) -> Iterator[tuple[int, int]]:
    """Trees over the groups of signatures that may reach the similarity."""
    if len(names) > 1:
        yield from _tree(_groups(may_link(signatures)), names)


def _between(alike: np.ndarray, names: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int]]:
    """One edge for each two linked groups of different blocks.

    The groups inside a block are held together by the trees of the block with itself.
    """
    inside = _groups(alike & (block[:, None] == block[None, :]))
    a, b = np.nonzero(alike & (block[:, None] < block[None, :]))
    pairs = inside[a] * len(names) + inside[b]
    for k in np.unique(pairs, return_index=True)[1].tolist():
        yield int(names[a[k]]), int(names[b[k]])


def _runs_of(rows: Iterable[tuple], width: int) -> Iterator[list[tuple]]:
    """Consecutive rows with the same first ``width`` values."""
    held: list[tuple] = []
    for row in rows:
        if held and held[0][:width] != row[:width]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _compare_buckets(rows: Iterable[tuple]) -> Iterator[tuple]:
    for own in _runs_of(rows, 1):
        names = np.array([r[1] for r in own], np.int64)
        yield from possible_links(names, np.frombuffer(b"".join(r[2] for r in own), np.uint8).reshape(-1, POSITIONS))


def _compare_blocks(rows: Iterable[tuple]) -> Iterator[tuple]:
    for own in _runs_of(rows, 3):
        names, block = np.array([r[3] for r in own], np.int64), np.array([r[5] for r in own])
        signatures = np.frombuffer(b"".join(r[4] for r in own), np.uint8).reshape(-1, POSITIONS)
        if own[0][1] == own[0][2]:
            yield from possible_links(names, signatures)
        else:
            yield from _between(may_link(signatures), names, block)


def _block_pairs(df: DataFrame, key: str, name: str, blocks: str) -> DataFrame:
    """One copy of each row for every pair of blocks of its group that holds its own block."""
    own = F.pmod(F.xxhash64(name, F.lit(17)), F.col(blocks)).cast("int")
    pair = F.struct(F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    return (
        df.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
        .withColumn("_pair", pair)
        .select(key, F.col("_pair.i").alias("_i"), F.col("_pair.j").alias("_j"), *[c for c in df.columns if c not in (key, blocks)], "_own")
    )


def _candidate_edges(classes: DataFrame) -> DataFrame:
    """Trees over groups of classes (``node, sig, roots``) that may be similar, from all runs."""

    def split(rows: Iterable[tuple]) -> Iterator[tuple]:
        for path, node, sig in rows:
            own = np.frombuffer(sig, np.uint8).reshape(1, -1)
            for child in next_paths(np.array([path], np.int64).view(np.uint64), own)[1].tolist():
                yield child, node

    members = classes.select(F.explode("roots").alias("path"), "node")
    classes = classes.select("node", "sig")
    found = None
    for level in range(1, LEVELS + 1):
        members = cut(members.distinct() if level > 1 else members)
        counts = cut(members.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        live = cut(members.join(counts, "path"))
        small = live.where(F.col("n") <= LIMIT)
        ordered = small.join(classes, "node").select("path", "node", "sig").repartition("path").sortWithinPartitions("path", "node")
        edges = cut(map_rows(ordered, _compare_buckets, "a long, b long").distinct())
        found = edges if found is None else found.unionByName(edges)
        big = live.where(F.col("n") > LIMIT)
        if not big.limit(1).count():
            return found
        wide = big.join(classes, "node")
        members = map_rows(wide.select("path", "node", "sig"), split, "path long, node long")
    blocks = wide.select("path", "node", "sig", F.ceil(F.col("n") / (LIMIT // 2)).alias("_blocks"))
    paired = _block_pairs(blocks, "path", "node", "_blocks").select("path", "_i", "_j", "node", "sig", "_own")
    paired = paired.repartition("path", "_i", "_j").sortWithinPartitions("path", "_i", "_j", "node")
    return found.unionByName(cut(map_rows(paired, _compare_blocks, "a long, b long").distinct()))


def exact_links(sets: list[np.ndarray], same_block: np.ndarray) -> np.ndarray:
    """Which pairs of shingle sets reach the similarity.

    ``same_block`` marks pairs that another pair of blocks compares already.
    """
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = np.array([[size[0], 0], [0, size[1]]])
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        both = np.zeros((len(sets), len(sets)))
        flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat, kind="stable")
        flat, own = flat[order], own[order]
        first = np.concatenate(([True], flat[1:] != flat[:-1]))
        column = np.cumsum(first) - 1
        shared = np.bincount(column)[column] > 1  # a shingle of one set is in no pair
        column, own = np.unique(column[shared], return_inverse=True)[1], own[shared]
        for at in range(0, int(column.max(initial=-1)) + 1, 8192):
            here = (column >= at) & (column < at + 8192)
            x = np.zeros((len(sets), 8192), np.float32)
            x[own[here], column[here] - at] = 1
            both += x @ x.T
    alike = both >= SIMILARITY * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(alike, False)
    return alike & ~same_block


def _verify(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Per block pair: each class with its links to others, and a tree over linked classes."""
    for own in _runs_of(rows, 3):
        if len(own) < 2:
            continue
        _, i, j = own[0][:3]
        names, copies = np.array([r[3] for r in own], np.int64), np.array([r[4] for r in own], np.int64)
        block = np.array([r[6] for r in own])
        done = (block[:, None] == block[None, :]) if i != j else np.zeros((len(own), len(own)), bool)
        alike = exact_links([np.frombuffer(r[5], "<u8") for r in own], done)
        texts, documents = alike.sum(axis=1), alike @ copies
        linked = np.flatnonzero(texts)
        for k in linked.tolist():
            yield int(names[k]), int(texts[k]), int(documents[k]), None
        if i == j:
            edges = _tree(_groups(alike | np.eye(len(own), dtype=bool))[linked], names[linked]) if len(linked) else ()
        else:
            inside = exact_links([np.frombuffer(r[5], "<u8") for r in own], ~done)
            edges = _between(alike | inside, names, block)
        for a, b in edges:
            yield a, 0, 0, b


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row per distinct (id, shingle set): ``doc_id, class_id, class_size, n_links,
    n_text_links``.

    ``class_id`` is the smallest id of the documents linked directly or through others,
    ``n_links`` the other documents of similarity 0.8 or more, copies included, and
    ``n_text_links`` the different shingle sets among them.
    """
    # A row is told by its id and a hash of its text, as ids may be NULL or repeat.
    slim = docs.select(
        F.coalesce(F.col(id_col), F.lit(LAST_ID)).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")
    )

    runs = runs_for(target_recall)

    def sketch(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (doc, row, _), words in with_words(rows, 2):
            s = np.unique(shingles(words))
            if len(s):
                values = minima(s)
                yield doc, row, *class_key(s), signature(values).tobytes(), first_paths(values, runs).tolist()
            else:
                yield doc, row, None, None, None, None

    seen = store(map_rows(slim, sketch, "id long, row long, node long, check long, sig binary, roots array<long>", 5000), "sketches")
    wordless = seen.where("node is null").select("id").distinct()
    light = seen.where("node is not null").select("id", "node", "check")
    # One row per document of a class; a class is told by both sums.
    kinds = cut(light.distinct().groupBy("node", "check").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    signatures = seen.where("node is not null").select(F.col("id").alias("rep"), "row", "node", "check", "sig", "roots")
    chosen = kinds.join(signatures, ["rep", "node", "check"]).dropDuplicates(["node"])
    classes = store(chosen.select("node", "rep", "row", "copies", "sig", "roots"), "classes")

    groups = connected_components(_candidate_edges(classes.select("node", "sig", "roots")))
    linked = _exact_links(slim, classes.drop("sig", "roots"), groups)
    counted = linked.where("tree is null").groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    whole = connected_components(linked.where("tree is not null").select(F.col("node").alias("a"), F.col("tree").alias("b")))

    named = classes.select("node", "rep", "copies").join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = cut(named.join(counted, "node", "left"))
    names = cut(named.groupBy("component").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size")))
    info = store(
        named.join(names, "component").select(
            "node",
            "class_id",
            "class_size",
            (F.col("copies") - 1 + F.coalesce("documents", F.lit(0))).alias("n_links"),
            F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        ),
        "class-info",
    )
    result = light.distinct().join(info, "node").drop("node", "check")
    alone = wordless.select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"))
    return result.unionByName(alone).withColumnRenamed("id", "doc_id")


def _exact_links(slim: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """Exact links within groups: ``node, texts, documents, tree`` (see ``_verify``)."""
    reps = cut(classes.join(groups, "node"))
    wanted = reps.select(F.col("rep").alias("id"), "row", F.col("node").alias("_node")).distinct()

    def sets(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (_, _, node), words in with_words(rows):
            s = np.unique(shingles(words))
            if len(s) and class_key(s)[0] == node:
                yield node, len(s), s.astype("<u8").tobytes()

    texts = slim.join(broadcast_if_small(wanted), ["id", "row"]).select("id", "text", "_node")
    held = store(map_rows(texts, sets, "node long, n int, shingles binary", 500).dropDuplicates(["node"]), "shingle-sets")
    sizes = held.select("node", "n").join(reps.select("node", "component"), "node").groupBy("component")
    sizes = cut(
        sizes.agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("_blocks"))
    )
    rows = reps.select("node", "component", "copies").join(sizes, "component").join(held.select("node", "shingles"), "node")
    paired = _block_pairs(rows.select("component", "node", "copies", "shingles", "_blocks"), "component", "node", "_blocks")
    paired = paired.repartition("component", "_i", "_j").sortWithinPartitions("component", "_i", "_j", "node")
    return cut(map_rows(paired.select("component", "_i", "_j", "node", "copies", "shingles", "_own"), _verify, "node long, texts long, documents long, tree long"))
