"""Benchmark items inside documents, by SimHash of item-sized windows.

For an item of L words every window of L words of a document that holds one of the item's
five-word shingles is fingerprinted (128-bit SimHash over the window's shingles, repeats
weighing more; windows without a shingle of an item have similarity 0 to it). Fingerprints
are split into 32 blocks of 4 bits, each with a table from block value to items: two
fingerprints within a radius of 31 agree in a block, so the tables yield every item within
the radius. Those items are verified by the exact weighted Jaccard similarity of the
shingle multisets, and pairs of 0.8 or more are returned. At a similarity of 0.8 fingerprints
differ in 19.4 bits on average (deviation 4.1), so the radius covers 99.8 % of windows at
the threshold, and more above it.

Items are read in blocks of bounded size; each block is one pass over the documents.

Defined cases: NULL texts and texts without words match nothing; an item of fewer than five
words is one shingle of all its words; a document shorter than an item is one window; equal
items each match; a row whose id or text repeats is returned once per id and text; an empty
benchmark or document table gives no rows; extra columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import map_rows
from funnelworks.llm.shingles import SHINGLE, SIMILARITY, mix, multiset, ngrams, weighted_jaccard, with_words, word_hashes

BLOCKS = 32
BLOCK_BITS = 4
RADIUS = BLOCKS - 1
# Characters of benchmark text (plus 100 an item) that one pass holds in each task.
ITEM_CHARS = 16_000_000
FILTER_BITS = 22


def _signs(shingle: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 128 bits of every shingle."""
    two = np.stack([mix(shingle), mix(shingle ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    return np.unpackbits(two.view(np.uint8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)


def fingerprints(shingle: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit SimHash of the shingle ranges [start, end), as two unsigned 64-bit values."""
    total = np.zeros((len(shingle) + 1, BLOCKS * BLOCK_BITS), np.int32)
    np.cumsum(_signs(shingle), axis=0, out=total[1:])
    return np.packbits(total[ends] - total[starts] > 0, axis=1).view(np.uint64)


def block_values(prints: np.ndarray) -> np.ndarray:
    """The 32 four-bit blocks of each fingerprint."""
    b = np.ascontiguousarray(prints).view(np.uint8)
    return np.stack([b >> 4, b & 15], axis=2).reshape(len(b), BLOCKS)


class ItemIndex:
    """Items of one length: fingerprints, block tables and shingle multisets."""

    def __init__(self, ids: list, words: list[np.ndarray]) -> None:
        n = min(SHINGLE, len(words[0]))
        self.ids, self.size, self.n = ids, len(words[0]), n
        grams = [ngrams(w, n) for w in words]
        self.sets = [multiset(g) for g in grams]
        self.prints = np.concatenate([fingerprints(g, np.array([0]), np.array([len(g)])) for g in grams])
        values = block_values(self.prints)
        self.tables = np.zeros((BLOCKS, 1 << BLOCK_BITS, len(ids)), bool)
        for b in range(BLOCKS):
            self.tables[b, values[:, b], np.arange(len(ids))] = True

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) pairs whose fingerprints differ in at most RADIUS bits."""
        values = block_values(prints)
        agree = np.zeros((len(prints), len(self.ids)), bool)
        for b in range(BLOCKS):
            agree |= self.tables[b, values[:, b]]
        at, item = np.nonzero(agree)
        apart = np.bitwise_count(prints[at] ^ self.prints[item]).sum(axis=1)
        return at[apart <= RADIUS], item[apart <= RADIUS]


class Items:
    """Indexes of a block of items, and a filter of the shingles that occur in them."""

    def __init__(self, rows: list[tuple]) -> None:
        words, ends = word_hashes([t for _, t in rows])
        by_size: dict[int, tuple[list, list]] = {}
        for (item, _), own in zip(rows, np.split(words, ends)[:-1], strict=True):
            if len(own):
                ids, held = by_size.setdefault(len(own), ([], []))
                ids.append(item)
                held.append(own)
        self.by_size = {k: ItemIndex(*v) for k, v in by_size.items()}
        # by shingle length: a bit filter, the sorted shingles, and the item sizes of each
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in {x.n for x in self.by_size.values()}:
            pairs = [(g, x.size) for x in self.by_size.values() if x.n == n for s in x.sets for g in s[0].tolist()]
            pairs = sorted(set(pairs))
            known = np.array([g for g, _ in pairs], np.uint64)
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[known >> np.uint64(64 - FILTER_BITS)] = True
            self.of[n] = bits, known, np.array([s for _, s in pairs])

    def matches(self, words: np.ndarray) -> Iterator[tuple]:
        """``(item, similarity, start, words)`` of the best window for each item found."""
        for n, (bits, known, sizes) in self.of.items():
            shingle = ngrams(words, n)
            at = np.flatnonzero(bits[shingle >> np.uint64(64 - FILTER_BITS)])
            lo, hi = np.searchsorted(known, shingle[at], "left"), np.searchsorted(known, shingle[at], "right")
            if not (hi > lo).any():
                continue
            times = hi - lo
            where = np.repeat(at, times)
            size = sizes[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            for s in np.unique(size).tolist():
                yield from self._windows(self.by_size[s], words, shingle, where[size == s])

    def _windows(self, index: ItemIndex, words: np.ndarray, shingle: np.ndarray, hits: np.ndarray) -> Iterator[tuple]:
        last = max(len(words) - index.size, 0)
        reach = index.size - index.n
        marks = np.zeros(last + 2, np.int64)
        np.add.at(marks, np.clip(hits - reach, 0, last), 1)
        np.add.at(marks, np.clip(hits, 0, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(marks)[:-1])
        best: dict[int, tuple] = {}
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for own in np.split(part, range(4096, len(part), 4096)):
                low = int(own[0])
                ends = np.minimum(own + reach + 1, len(shingle))
                prints = fingerprints(shingle[low : int(ends[-1])], own - low, ends - low)
                for w, i in zip(*(x.tolist() for x in index.within(prints)), strict=True):
                    alike = weighted_jaccard(multiset(shingle[own[w] : ends[w]]), index.sets[i])
                    if alike >= SIMILARITY and (i not in best or alike > best[i][0]):
                        best[i] = alike, int(own[w])
        for i, (alike, start) in sorted(best.items()):
            yield index.ids[i], alike, start, min(index.size, len(words) - start)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, item_id, similarity, start_word, n_words``: the best window of
    every document that holds a benchmark item, per item."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 100).alias("n")).first()["n"] or 0
    passes = max(1, -(-total // ITEM_CHARS))
    types = dict(slim.dtypes) | dict(items.select("item_id").dtypes)
    schema = f"doc_id {types['doc_id']}, text_hash long, item_id {types['item_id']}, similarity double, start_word int, n_words int"
    out = None
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        found = _one_pass(slim, [tuple(r) for r in own.sort("item_id", "text").collect()], schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _one_pass(slim: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast(rows)

    def find(docs: Iterable[tuple]) -> Iterator[tuple]:
        items = Items(shared.value)
        for (doc, _, text_hash), words in with_words(docs):
            for item, alike, start, n in items.matches(words):
                yield doc, text_hash, item, alike, start, n

    return map_rows(slim, find, schema)
