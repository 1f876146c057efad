"""Removal of lines that repeat across documents.

Lines are exploded to (document, position, key hash), the distinct documents of a hash are
told from the smallest and largest id that hold it, and repeated lines go from every
document but the first. Only 16-byte hashes of the lines are shuffled; the texts meet the
positions to drop once, by document.

Defined cases: a NULL or empty text is one empty line and stays; rows with the same id are
one document for the counts; a NULL id counts as one id after all others; an empty table
gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import cut, map_rows

MIN_CODE_POINTS = 10
LAST_ID = (1 << 63) - 1


def line_key(line: bytes) -> bytes:
    """A UTF-8 line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CODE_POINTS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` with repeated lines only in their first document.

    ``text`` is the kept text. A key of at least ``min_chars`` code points found in two or
    more documents stays in the one with the smallest id (all its occurrences there).
    """
    # A row is told by its id and a hash of its text, as ids may repeat.
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col), F.lit(LAST_ID)).cast("long").alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("_row", F.xxhash64("text"))

    def explode(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc, row, text in rows:
            for at, line in enumerate(text.encode().split(b"\n")):
                if _long_enough(key := line_key(line), min_chars):
                    yield doc, row, at, md5(key, usedforsecurity=False).digest()

    lines = cut(map_rows(slim.select("_id", "_row", "text"), explode, "_id long, _row long, at int, hash binary"))
    repeated = cut(
        lines.groupBy("hash")
        .agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
        .where("_first < _last")
        .select("hash", "_first")
    )
    # Both sides come from checkpoints, so Spark splits the partition of a very common line.
    dropped = (
        lines.join(repeated, "hash")
        .where("_id <> _first")
        .groupBy("_id", "_row")
        .agg(F.collect_set("at").alias("gone"))
    )

    def rebuild(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc, text, gone in rows:
            lines = text.split("\n")
            out = set(gone or ())
            kept = "\n".join(x for i, x in enumerate(lines) if i not in out) if out else text
            yield doc, kept, len(lines), len(out)

    whole = slim.join(dropped, ["_id", "_row"], "left").select("doc_id", "text", "gone")
    id_type = whole.schema["doc_id"].dataType.simpleString()
    return map_rows(whole, rebuild, f"doc_id {id_type}, text string, n_lines long, n_dropped long", 1000)
