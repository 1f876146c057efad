"""Language-model scores of documents with stupid back-off.

The corpus is kept in batches of whole documents, stored in buckets by batch. A batch sends its
distinct n-gram hashes with their counts to hash partitions; a partition sums the counts of all
batches (the n-gram count table, partitioned by hash) and joins them back to the batches'
n-grams; a batch then scores its documents from the counts of their exploded n-grams and sums
per document. An n-gram is sent once a batch however often it occurs, so a very common one makes
no large group, and the counts cover the whole corpus and grow with it. The counts are joined to
the stored batches bucket by bucket, so texts are on disk once and never shuffled.

A document is scored by all other documents: its own n-grams are taken off the corpus counts,
as it would otherwise tell all of its n-grams itself and never back off. The score of a word
after its history is count(n-gram) / count(history) for the longest n-gram that the others have,
once or more, times ``BACKOFF`` for every order left out; single words score count / words of
the others, and a word that no other document has ``BACKOFF`` / words of the corpus. The first
words of a document have shorter histories, without back-off.

Defined cases: NULL texts and texts without words have 0 words, log score 0.0 and a NULL
mean; rows with the same id are scored each by its own text, and each counts; an empty table
gives no rows; extra columns of the input are ignored. n-grams are told by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import map_rows, store_in_buckets
from funnelworks.llm.shingles import ngrams, word_hashes
from funnelworks.operators.partitioning import shuffle_partitions

ORDER = 3
BACKOFF = 0.4
# A larger batch shares more of its n-grams among its documents (8,000,000 characters send a tenth
# less than 4,000,000), and a task holds it whole.
BATCH_CHARS = 8_000_000
# Words of the corpus for each hash partition of the count table.
PARTITION_WORDS = 2_000_000


def _press(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: small values cost about a byte."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpress(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _batches(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Documents of a partition as rows of (batch, ids, lengths, compressed text, words)."""
    ids, texts, size, n, part = [], [], 0, 0, 0

    def flush() -> tuple:
        nonlocal size, n
        raw = [t.encode() for t in texts]
        words = len(word_hashes(texts)[0])
        out = part << 32 | n, list(ids), np.array([len(r) for r in raw], "<i8").tobytes(), zstandard.compress(b"".join(raw), 3), words
        ids.clear(), texts.clear()
        size, n = 0, n + 1
        return out

    for part, doc, text in rows:  # noqa: B007 - the closure reads the last part
        ids.append(doc)
        texts.append(text or "")
        size += len(texts[-1]) + 100
        if size >= BATCH_CHARS:
            yield flush()
    if ids:
        yield flush()


def _texts(lengths: bytes, blob: bytes) -> list[str]:
    raw, out, at = zstandard.decompress(blob), [], 0
    for n in np.frombuffer(lengths, "<i8").tolist():
        out.append(raw[at : at + n].decode())
        at += n
    return out


def _grams(texts: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """n-gram hashes of each document for n from 1 to ``order``, and the documents' words."""
    words, ends = word_hashes(texts)
    docs = np.split(words, ends[:-1])
    return [np.concatenate([ngrams(d, n) for d in docs]) for n in range(1, order + 1)], np.array([len(d) for d in docs])


def _own_counts(back: np.ndarray, grams: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """How often the document of each n-gram has it; ``back`` numbers the n-grams by their hash."""
    docs = [np.repeat(np.arange(len(sizes)), np.maximum(sizes - n, 0)) for n in range(len(grams))]
    key = np.concatenate(docs) * (int(back.max(initial=0)) + 1) + back
    _, place, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[place]


def _scores(counts: list[np.ndarray], sizes: np.ndarray, total: int, backoff: float) -> np.ndarray:
    """Log score of each document from the others' counts of its n-grams by order."""
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(of)) - first[of]
    words = np.where(counts[0] > 0, counts[0], backoff)
    log_score = np.log(words / np.where(counts[0] > 0, (total - sizes)[of], total))
    for n in range(2, len(counts) + 1):
        # n-grams of order n end at the words from the n-th of a document on
        ends = np.flatnonzero(at >= n - 1)
        seen = counts[n - 1] > 0
        history = np.maximum(counts[n - 2][_starts(sizes, n)], 1)
        direct = np.log(np.maximum(counts[n - 1], 1) / history)
        log_score[ends] = np.where(seen, direct, np.log(backoff) + log_score[ends])
    return np.bincount(of, log_score, len(sizes))


def _starts(sizes: np.ndarray, n: int) -> np.ndarray:
    """Places, among the n-grams of order n - 1, of the histories of those of order n."""
    longer, shorter = np.maximum(sizes - n + 1, 0), np.maximum(sizes - n + 2, 0)
    first = np.cumsum(shorter) - shorter
    return np.repeat(first, longer) + np.arange(longer.sum()) - np.repeat(np.cumsum(longer) - longer, longer)


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    backoff: float = BACKOFF,
) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` of every document, told by the others."""
    slim = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "batch long, ids array<long>, lengths binary, texts binary, words long"
    buckets = shuffle_partitions(docs.sparkSession)
    batches, bucketed = store_in_buckets(map_rows(slim, _batches, schema, 1), "batches", "batch", buckets)
    total = batches.agg(F.sum("words").alias("n")).first()["n"] or 0
    parts = max(1, -(-total // PARTITION_WORDS))

    def send(rows: Iterable[tuple]) -> Iterator[tuple]:
        """The distinct n-grams of each batch, by range of their hashes."""
        for batch, lengths, texts in rows:
            keys, n = np.unique(np.concatenate(_grams(_texts(lengths, texts), order)[0]), return_counts=True)
            part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                own = keys[edges[p] : edges[p + 1]]
                yield p, batch, _press(np.diff(own, prepend=np.uint64(0))), _press(n[edges[p] : edges[p + 1]].astype("<u4"))

    def count(rows: Iterable[tuple]) -> Iterator[tuple]:
        """The corpus counts of each batch's n-grams, partition by partition."""
        held: list[tuple] = []

        def answer() -> Iterator[tuple]:
            keys = [np.cumsum(_unpress(k, "<u8"), dtype=np.uint64) for _, k, _ in held]
            own, back = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(back, np.concatenate([_unpress(n, "<u4") for _, _, n in held]), len(own)).astype("<u8")[back]
            at = 0
            for (batch, _, _), k in zip(held, keys, strict=True):
                yield p_now, batch, _press(sums[at : at + len(k)])
                at += len(k)
            held.clear()

        p_now = None
        for p, batch, k, n in rows:
            if held and p != p_now:
                yield from answer()
            p_now = p
            held.append((batch, k, n))
        if held:
            yield from answer()

    sent = map_rows(batches.select("batch", "lengths", "texts"), send, "p int, batch long, keys binary, counts binary", 16)
    tables = sent.repartition(parts, "p").sortWithinPartitions("p", "batch")
    answers = map_rows(tables, count, "p int, batch long, counts binary", 16)

    def score(rows: Iterable[tuple]) -> Iterator[tuple]:
        """Batches with the answers to them, which are taken in order of their hashes."""
        for ids, lengths, blob, told in rows:
            grams, sizes = _grams(_texts(lengths, blob), order)
            if sizes.sum():
                _, back = np.unique(np.concatenate(grams), return_inverse=True)
                counts = [_unpress(t["counts"], "<u8") for t in sorted(told, key=lambda t: t["p"])]
                others = np.concatenate(counts)[back].astype(np.int64) - _own_counts(back, grams, sizes)
                by_order = np.split(others, np.cumsum([len(g) for g in grams])[:-1])
                result = _scores([c.astype(np.float64) for c in by_order], sizes, total, backoff)
            else:
                result = np.zeros(len(sizes))
            for doc, n, s in zip(ids, sizes.tolist(), result.tolist(), strict=True):
                yield doc, n, s, s / n if n else None

    # As many partitions as buckets: the join moves the answers alone.
    told = answers.repartition(buckets, "batch").groupBy("batch").agg(F.collect_list(F.struct("p", "counts")).alias("told"))
    both = bucketed.join(told, "batch", "left").select("ids", "lengths", "texts", "told")
    return map_rows(both, score, "doc_id long, n_words long, log_score double, mean_log_score double", 5000)
