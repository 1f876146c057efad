"""Mixing sources to target weights by hash thresholds.

Each source has a budget of words. A document's place in its source is fixed by a 48-bit
hash of its id and text; the mix takes every document of a source ``repeats`` times and those below
a hash threshold once more. The thresholds come from histograms of words by (source, hash
bucket): the bucket in which the budget is reached is split into finer buckets, level by
level, until it is a single hash value. No document is sorted; a larger budget takes a
superset of a smaller one, and reruns agree. DataFrame functions only.

Defined cases: a NULL source is one source, last in order; NULL and empty texts have size 0
and are never taken (0 copies); rows of one id, or of none, have places of their own by their
texts, while rows that agree in both are taken together; a source without words has target 0;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.llm.common import broadcast_if_small, cut

WEIGHTS = (1, 2, 3)
CAP = 3
HASH_BITS = 48
LEVEL_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Words to take from each source: ``(key, source_size, target)``; one row per source.

    Sources in ``key`` order get the weights in turn and share the total by weight, but none
    more than ``cap`` times its size; what is above is shared again by weight. That fixed
    point is ``min(cap * size, level * weight)``: with the sources ordered by the level at
    which they reach their cap, the level is the largest of (total - caps before) / (weights
    from here on).
    """
    in_order, by_level = Window.orderBy("key"), Window.orderBy(F.col("_cap") / F.col("_w"), "key")
    everything = Window.partitionBy(F.lit(1))
    weighted = sizes.select(
        "key",
        "source_size",
        F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")).alias("_w"),
        (F.col("source_size") * cap).alias("_cap"),
    )
    left = F.sum("source_size").over(everything) - (F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap"))
    level = left / F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    return weighted.withColumn("_level", level).select(
        "key",
        "source_size",
        F.least(F.col("_cap").cast("double"), F.max("_level").over(everything) * F.col("_w")).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
) -> DataFrame:
    """Words taken from every document: ``doc_id, size, source_size, target, copies, taken, text_hash``.

    ``copies`` is how many times the mix holds the document, ``text_hash`` the xxhash64 of its text. The words taken from a source
    differ from its target by at most half the size of its boundary document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_key = F.encode(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), text), "UTF-8")
    place = F.conv(F.substring(F.md5(doc_key), 1, HASH_BITS // 4), 16, 10).cast("long")
    slim = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            # 's' + name in code point order, then 't' for the missing name
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t")).alias("key"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            place.alias("place"),
            F.xxhash64(text_col).alias("text_hash"),
        )
    )
    sizes = cut(slim.groupBy("key").agg(F.sum("size").alias("source_size")))
    budgets = cut(
        source_targets(sizes, weights, cap).withColumn(
            "repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        )
    )
    frontier = budgets.select(
        "key",
        (F.col("target") - F.col("repeats") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("words"),
    )
    for used in range(0, HASH_BITS, LEVEL_BITS):
        frontier = _refine(slim, frontier, used)
    chosen = budgets.join(
        frontier.select("key", "prefix", (F.col("rest") * 2 >= F.col("words")).alias("with_last")), "key", "left"
    )
    extra = (F.col("place") < F.col("prefix")) | ((F.col("place") == F.col("prefix")) & F.col("with_last"))
    copies = F.when(F.col("size") > 0, F.col("repeats") + F.when(extra, 1).otherwise(0)).otherwise(0)
    return slim.join(broadcast_if_small(cut(chosen)), "key").select(
        "doc_id", "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).alias("taken"), "text_hash"
    )


def _refine(slim: DataFrame, frontier: DataFrame, used: int) -> DataFrame:
    """Split each source's boundary bucket (``used`` hash bits) and find the finer boundary.

    Only rows of a boundary bucket are summed again. ``rest`` becomes the budget left at the
    boundary's start, ``words`` the words in it.
    """
    edge = frontier.select("key", "rest", F.col("prefix").alias("_at"))
    inside = slim.join(broadcast_if_small(cut(edge)), "key").where(F.shiftright("place", HASH_BITS - used) == F.col("_at"))
    finer = F.shiftright("place", HASH_BITS - used - LEVEL_BITS).alias("prefix")
    sums = inside.groupBy("key", "rest", finer).agg(F.sum("size").alias("words"))
    up_to = F.sum("words").over(Window.partitionBy("key").orderBy("prefix"))
    reached = sums.withColumn("_cum", up_to).where(F.col("_cum") > F.col("rest"))
    first = reached.groupBy("key").agg(F.min_by(F.struct("rest", "_cum", "prefix", "words"), "prefix").alias("e"))
    return first.select(
        "key",
        (F.col("e.rest") - (F.col("e._cum") - F.col("e.words"))).alias("rest"),
        F.col("e.prefix").alias("prefix"),
        F.col("e.words").alias("words"),
    )
