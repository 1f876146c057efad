"""Toxicity scores from a factorization machine over hashed terms.

The terms of a document are the hashed character 4- and 5-grams of its words, with the word
ends marked, so unseen forms of a known word share terms with it. A document's score is a
logistic function of a bias, the weights of its distinct terms and all pairwise products of
their factors, which an additive model has no term for (an insult together with the mention
of a group).

The machine is fitted on a bounded sample of labelled rows (``max_per_class`` rows of each
label, those with the smallest hash of the id; whole texts). Every term of at least
``MIN_DOCS`` of its documents has a weight and factors, so that pairs of terms are learnt that
occur alone as often in either label. Terms whose share of toxic documents is beyond chance,
by the Chernoff bound over the terms tried, have the value 1 in a document; the others share
a length of 1, as most of them say nothing. The counts behind that are a Spark aggregation
over the sample. One task fits, as the sample is bounded; the driver holds the parameters. A
row of the sample weighs as many labelled rows as it stands for, so bias and scores follow the
labels' true ratio, whatever the bound. Every document of the table is scored on its whole text.

Defined cases: NULL and empty texts have no terms and get the score of the bias; without
labelled rows of both kinds all scores are 0.0; rows with the same id are scored each by its
own text, but learnt from by the first of their texts alone; several labels of an id count as
the largest, NULL labels as none; an empty table gives no rows; extra columns of the inputs
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import cut, map_rows, store

TERM_BITS = 24
GRAMS = (4, 5)
FACTORS = 4
MAX_PER_CLASS = 4000
STEPS = 4000
BATCH = 32
RATE = 0.2
DECAY = 1e-4
# A term needs this many documents of the sample to have parameters.
MIN_DOCS = 3
PREDICT_AT = 0.7
# Characters that are hashed at a time; a longer text is cut into overlapping slices.
SLICE = 1 << 18

BETWEEN = re.compile(r"\W+")


def _hashed(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of the n-grams at every place of a text given by its code points."""
    h = codes
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + np.uint32(n)
            yield n, (mixed ^ (mixed >> np.uint32(13))) >> np.uint32(32 - TERM_BITS)


def terms_of(texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, term) pairs of texts; with ``keep``, of the terms marked there."""
    found = [np.zeros(0, np.int64)]
    held, size = [], 0

    def take() -> None:
        codes = np.frombuffer("".join(s for _, s in held).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends, own = np.cumsum([len(s) for _, s in held]), np.array([i for i, _ in held], np.int64)
        for n, h in _hashed(codes):
            at = np.flatnonzero(keep[h]) if keep is not None else np.arange(len(h))
            inside = np.ones(len(at), bool)
            for k in range(n):  # a gram may begin with '<' and end with '>' but not cross them
                c = codes[at + k]
                if k:
                    inside &= c != 60
                if k < n - 1:
                    inside &= c != 62
            at = at[inside]
            doc = own[np.searchsorted(ends, at, "right")]
            found.append(np.unique(doc << TERM_BITS | h[at]))
        held.clear()

    for i, text in enumerate(texts):
        marked = f"<{BETWEEN.sub('><', text.lower())}>" if text else ""
        for at in range(0, len(marked), SLICE):
            part = marked[at : at + SLICE + max(GRAMS) - 1]
            held.append((i, part if part.endswith(">") else part + "<"))
            size += len(part)
            if size >= SLICE:
                take()
                size = 0
    if held:
        take()
    pairs = np.unique(np.concatenate(found))
    return pairs >> TERM_BITS, pairs & ((1 << TERM_BITS) - 1)


@dataclass
class Machine:
    """Fitted parameters: bias, the sorted terms that have parameters, their weights and factors,
    and which of them tell the labels apart on their own."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    telling: np.ndarray | None = None

    def marks(self) -> np.ndarray:
        keep = np.zeros(1 << TERM_BITS, bool)
        keep[self.terms] = True
        return keep

    def score(self, texts: list[str | None], keep: np.ndarray | None = None) -> np.ndarray:
        """Probability of label 1 of each text."""
        doc, term = terms_of(texts, self.marks() if keep is None else keep)
        return 1 / (1 + np.exp(-np.clip(_logits(self, doc, np.searchsorted(self.terms, term), len(texts)), -35, 35)))


def _values(doc: np.ndarray, at: np.ndarray, n: int, telling: np.ndarray | None) -> np.ndarray:
    """Value of each term of a document: 1 if it tells the labels apart on its own; the others
    share a length of 1, so that many of them weigh no more than one that tells."""
    if telling is None:
        return np.ones(len(at))
    own = telling[at]
    return np.where(own, 1.0, 1 / np.sqrt(np.maximum(np.bincount(doc, ~own, n), 1))[doc])


def _logits(m: Machine, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    x = _values(doc, at, n, m.telling)
    v = m.factors[at] * x[:, None]
    s = np.stack([np.bincount(doc, v[:, k], n) for k in range(v.shape[1])], axis=1)
    return m.bias + np.bincount(doc, m.weights[at] * x, n) + 0.5 * ((s**2).sum(axis=1) - np.bincount(doc, (v**2).sum(axis=1), n))


def tells(base: float, tried: int) -> Column:
    """Whether a term's share of label 1 (``ones`` of ``n``) differs from the base beyond chance.

    Chance gives n documents a share s with probability at most exp(-n * KL(s, base)); that
    must be under 1/e**2 for all terms tried together.
    """
    share = F.col("ones") / F.col("n")
    ones = F.when(share > 0, share * F.log(share / base)).otherwise(0.0)
    zeros = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return F.col("n") * (ones + zeros) > float(np.log(max(tried, 1))) + 2


def fit(
    rows: list[np.ndarray],
    labels: np.ndarray,
    terms: np.ndarray,
    factors: int = FACTORS,
    steps: int = STEPS,
    seed: int = 7,
    telling: np.ndarray | None = None,
    share: float | None = None,
) -> Machine:
    """Fit by AdaGrad on the logistic loss. Rows of the rarer label weigh more, by the square
    root of the ratio: between finding all of them and flagging few of the others.

    ``rows`` holds the positions of each document's terms in ``terms``; ``telling`` marks the
    terms that tell the labels apart on their own (all, if None); ``share`` is that of label 1
    where the rows come from (theirs, if None).
    """
    y = np.asarray(labels, np.float64)
    rng = np.random.default_rng(seed)
    weights, vectors, bias = np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), factors)), 0.0
    g_weights, g_vectors, g_bias = np.ones(len(terms)), np.ones((len(terms), factors)), 1.0
    share = y.mean() if share is None else share
    # A row weighs what it stands for, and one of the rarer label more.
    cost = np.where(y == 1, share / y.mean() * np.sqrt((1 - share) / share), (1 - share) / (1 - y.mean()))
    sizes = np.array([len(r) for r in rows])
    values = [_values(np.zeros(len(r), np.int64), r, 1, telling).astype(np.float32) for r in rows]
    order, at = rng.permutation(len(rows)), 0
    seen, place = np.zeros(len(terms), bool), np.zeros(len(terms), np.int64)
    for _ in range(steps):
        if at >= len(order):
            order, at = rng.permutation(len(rows)), 0
        own = order[at : at + BATCH]
        at += BATCH
        held = np.concatenate([rows[i] for i in own])
        seen[held] = True
        touched = np.flatnonzero(seen)
        seen[touched] = False
        place[touched] = np.arange(len(touched))
        # the batch as a matrix over the terms it touches
        x = np.zeros((len(own), len(touched)))
        x[np.repeat(np.arange(len(own)), sizes[own]), place[held]] = np.concatenate([values[i] for i in own])
        x2 = x * x
        w, v = weights[touched], vectors[touched]
        s = x @ v
        z = bias + x @ w + 0.5 * ((s**2).sum(axis=1) - x2 @ (v**2).sum(axis=1))
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[own]) * cost[own]
        g = error @ x + DECAY * w
        seen_w = g_weights[touched] + g**2
        g_weights[touched] = seen_w
        weights[touched] = w - RATE * g / np.sqrt(seen_w)
        gv = np.clip(x.T @ (error[:, None] * s) - (error @ x2)[:, None] * v, -1, 1) + DECAY * v
        seen_v = g_vectors[touched] + gv**2
        g_vectors[touched] = seen_v
        vectors[touched] = v - 0.1 * RATE * gv / np.sqrt(seen_v)
        g_bias += error.sum() ** 2
        bias -= RATE * error.sum() / np.sqrt(g_bias)
    return Machine(float(bias), terms, weights, vectors, telling)


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Machine | None:
    """Fit on at most ``max_per_class`` labelled documents of each label."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = cut(known.withColumn("_at", F.xxhash64("doc_id")))
    chosen = [known.where(F.col("toxic") == F.lit(x)).orderBy("_at", "doc_id").limit(max_per_class) for x in (False, True)]
    # Bounded by the parameter, so the ids may be broadcast to the one scan of the texts.
    ids = F.broadcast(cut(chosen[0].unionByName(chosen[1]).drop("_at")))
    # One text an id, the first of several, so that the sample is bounded by the ids.
    texts = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = store(texts.select("text", F.col("toxic").cast("int").alias("toxic")), "labelled")

    def count(rows: Iterable[tuple]) -> Iterator[tuple]:
        for texts, toxic in _chunks(rows):
            doc, term = terms_of(texts)
            at, back = np.unique(term, return_inverse=True)
            ones = np.bincount(back, np.asarray(toxic)[doc], len(at)).astype(np.int64)
            yield from zip(at.tolist(), np.bincount(back, minlength=len(at)).tolist(), ones.tolist(), strict=True)

    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("ones")).first()
    if not total["n"] or not 0 < total["ones"] < total["n"]:
        return None
    counts = map_rows(sample, count, "term int, n long, ones long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    # At least this many documents are needed to differ from the base share beyond chance.
    base = total["ones"] / total["n"]
    least = int(2 / max(-np.log(base), -np.log1p(-base)))
    counts = cut(counts.where((F.col("n") > least) | (F.col("n") >= MIN_DOCS)))
    telling = (F.col("n") > least) & tells(base, counts.where(F.col("n") > least).count())
    chosen = counts.withColumn("telling", telling).where(F.col("telling") | (F.col("n") >= MIN_DOCS)).select("term", "telling").toPandas().sort_values("term")
    terms, telling = chosen["term"].to_numpy(np.int64), chosen["telling"].to_numpy(bool)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def held(rows: Iterable[tuple]) -> Iterator[tuple]:
        keep = np.zeros(1 << TERM_BITS, bool)
        keep[shared.value] = True
        for texts, toxic in _chunks(rows):
            doc, term = terms_of(texts, keep)
            own = np.split(np.searchsorted(shared.value, term).astype("<i4"), np.searchsorted(doc, np.arange(1, len(texts))))
            yield from ((x.tobytes(), t) for x, t in zip(own, toxic, strict=True))

    # Positions in ``terms`` of at most 2 * max_per_class documents: one task takes them all.
    rows = map_rows(sample, held, "terms binary, toxic int", 500).repartition(1).sortWithinPartitions("terms", "toxic")
    true_share = known.agg(F.avg(F.col("toxic").cast("int"))).first()[0]

    def fitted(rows: Iterable[tuple]) -> Iterator[tuple]:
        own, toxic = zip(*rows, strict=True)
        machine = fit([np.frombuffer(x, "<i4") for x in own], np.array(toxic), shared.value, telling=told.value, share=true_share)
        yield machine.bias, machine.weights.astype("<f8").tobytes(), machine.factors.astype("<f8").tobytes()

    told = docs.sparkSession.sparkContext.broadcast(telling)
    (found,) = store(map_rows(rows, fitted, "bias double, weights binary, factors binary", 1), "machine").collect()
    weights, factors = np.frombuffer(found["weights"], "<f8"), np.frombuffer(found["factors"], "<f8").reshape(len(terms), -1)
    return Machine(found["bias"], terms, weights, factors, telling)


def _chunks(rows: Iterable[tuple], chars: int = SLICE) -> Iterator[tuple[list, list]]:
    """Rows of (text, value) gathered into lists of about ``chars`` characters."""
    texts, values, size = [], [], 0
    for text, value in rows:
        texts.append(text)
        values.append(value)
        size += len(text or "") + 100
        if size >= chars:
            yield texts, values
            texts, values, size = [], [], 0
    if texts:
        yield texts, values


def held_out(doc_id: int) -> bool:
    """Whether a document's label must not be learnt from."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def score_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3
    machine = train(slim, labels.select("doc_id", "toxic").where(fold != 1))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(rows: Iterable[tuple]) -> Iterator[tuple]:
        machine = shared.value
        keep = machine.marks() if machine else None
        for texts, ids in _chunks((text, doc) for doc, text in rows):
            p = machine.score(texts, keep).tolist() if machine else [0.0] * len(ids)
            yield from ((i, i is not None and held_out(i), x, int(x >= PREDICT_AT)) for i, x in zip(ids, p, strict=True))

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return map_rows(slim, score, f"doc_id {id_type}, held_out boolean, score double, predicted int", 5000)
