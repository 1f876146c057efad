"""Words and word n-grams of texts as 64-bit hashes, computed on whole chunks with numpy.

A word is a maximal run of letters, digits and underscores (Unicode), lower-cased; its hash
is a polynomial of its code points. Long texts are cut between words, so memory is bounded
by the chunk and not by the text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 1 << 18
SHINGLE = 5
SIMILARITY = 0.8

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.cache
def _word_characters() -> np.ndarray:
    """Whether each code point belongs to a word."""
    out = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    out[ord("_")] = True
    return out


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    ones = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    for a in ones:
        a[0] = 1
    return tuple(np.cumprod(a, dtype=np.uint64) for a in ones)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _cuts(text: str) -> Iterator[str]:
    """A text in parts of about CHUNK characters, cut where a word has ended."""
    at = 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words end."""
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    held: list[tuple[int, str]] = []
    size = 0

    def take() -> None:
        codes = np.frombuffer("\n".join(s for _, s in held).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = _word_characters()[codes]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers(max(len(codes).bit_length(), 16))
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * down[start]))
        ends = np.cumsum([len(s) + 1 for _, s in held])
        np.add.at(counts, np.array([i for i, _ in held])[np.searchsorted(ends, start, "right")], 1)
        held.clear()

    for i, text in enumerate(texts):
        for part in _cuts(text.lower()) if text else ():
            held.append((i, part))
            size += len(part)
            if size >= CHUNK:
                take()
                size = 0
    if held:
        take()
    return np.concatenate(hashes), np.cumsum(counts)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words at every place of one word sequence."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k : len(words) - n + 1 + k]
    return mix(out + np.uint64(n))


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the word n-grams in order; of a shorter text, the one of all its words."""
    return ngrams(words, min(n, len(words))) if len(words) else words


def chunks(rows: Iterable[tuple], text_at: int = 1, chars: int = CHUNK) -> Iterator[list[tuple]]:
    """Rows gathered into lists of about ``chars`` characters of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at] or "") + 100
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def with_words(rows: Iterable[tuple], text_at: int = 1) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each row with the word hashes of its text."""
    for held in chunks(rows, text_at):
        words, ends = word_hashes([r[text_at] for r in held])
        at = 0
        for row, end in zip(held, ends.tolist(), strict=True):
            yield row, words[at:end]
            at = end


def multiset(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller over sum of larger counts of two multisets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)
