"""Token ids of a corpus as compact binary files, and their reader.

Ids are ranked by their frequency over the whole corpus, so common ids take one byte. A
block codes its ranks byte-aligned: two bits of length per rank in separate control bytes
(four ranks a byte) and the 1 to 4 little-endian data bytes in a stream of their own. The
reader expands control bytes through a 256-row table and gathers the data with numpy.

File format: Parquet as the container, one row per block of whole documents, written and
committed by Spark: ``part, block, before, doc_ids, lengths, control, data`` where ``part``
is the range partition of ids, ``before`` the ids of earlier blocks of the part, and
``doc_ids`` and ``lengths`` are little-endian 64-bit integers. A second table ``ranks``
holds ``rank, id, n``.

Defined cases: a NULL or empty text is one end id; rows with the same id follow each other
in an unspecified order of equal texts (by checksum otherwise); a NULL id sorts first; an
empty table gives an empty file; extra columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelworks.llm.common import OUT_ROWS, map_rows
from funnelworks.session import shared_path

END_ID = 1
BLOCK_IDS = 1 << 19
# Bound on the words each Python worker remembers, the latest ones.
CACHE_WORDS = 600_000
# Characters of the texts encoded at a time, and pieces given to the tokenizer at a time.
BATCH_CHARS = 12_000_000
PIECES_A_CALL = 1000

# First steps of a tokenizer that texts can be encoded word by word for: normal form, white
# space to one space, lower case; pieces by this pattern, spelt in bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FIRST_STEPS = {
    "normalizer": ["NFC", ("Replace", r"\s+", " "), "Lowercase"],
    "pre_tokenizer": [("Split", PATTERN, "Removed", True), ("ByteLevel", False, False)],
}
PIECES = regex.compile(PATTERN)
# Lower-casing the first two depends on the context or changes the length, the others are
# white space for Python alone or a special token's start: such texts, and those not in
# normal form, go through the tokenizer whole.
UNSAFE = ("İ", "Σ", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "<|")


# Libraries differ in the Unicode version by which they tell letters; up to here they agree.
LAST_LATIN = "\u024f"


def _first_steps(file: dict) -> dict[str, list]:
    """What a tokenizer's file says of its normalizer and pre-tokenizer, in short."""

    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if part is None else part[inner] if part["type"] == "Sequence" else [part]

    def normalizer(step: dict) -> object:
        return (step["type"], step["pattern"].get("Regex"), step["content"]) if step["type"] == "Replace" else step["type"]

    def pre_tokenizer(step: dict) -> object:
        if step["type"] == "Split":
            return step["type"], step["pattern"].get("Regex"), step["behavior"], step["invert"]
        if step["type"] == "ByteLevel":
            return step["type"], step["add_prefix_space"], step["use_regex"]
        return step["type"]

    return {
        "normalizer": [normalizer(x) for x in steps(file.get("normalizer"), "normalizers")],
        "pre_tokenizer": [pre_tokenizer(x) for x in steps(file.get("pre_tokenizer"), "pretokenizers")],
    }


class WordCoder:
    """Encodes texts with a ``tokenizers`` file, remembering the ids of words.

    Where the file's first steps are those above, white space separates pieces and a text's ids
    are those of its words in turn: Arrow tells the words of many texts, and each different one
    is encoded once, if not remembered. Texts go through any other tokenizer whole.
    """

    _loaded: dict[str, WordCoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        # Spark deals the texts to tasks, each of which needs one thread.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _first_steps(json.loads(Path(path).read_text(encoding="utf-8"))) == FIRST_STEPS
        # The tokenizer's model behind first steps that do no more than pieces need.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, ids = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(ids.values(), default=0), bool)
        self.ends[[i for token, i in ids.items() if suffix and token.endswith(suffix)]] = True
        # The words remembered (a piece is a word of one piece), the latest last, and their ids.
        self.words = pa.array([], pa.large_string())
        self.ids = _lists([])

    @classmethod
    def of(cls, path: str) -> WordCoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces by the tokenizer's model alone; its first steps cost more."""
        (coded,) = self.plain.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)
        ids = np.asarray(coded.ids, dtype="<u4")
        ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(ends) != len(pieces):  # the model does not mark every end
            return [self._ids(p) for p in pieces]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _word_ids(self, words: list[str]) -> pa.ListArray:
        """The ids of words in lower case, by their pieces."""
        parts, ends = [], [0]
        for word in words:
            if word.isalpha() or _beyond(word):
                parts.append(word)
            elif word[-1:] in ".,;:" and word[:-1].isalpha():
                parts += (word[:-1], word[-1])
            else:
                parts += PIECES.findall(word)
            ends.append(len(parts))
        coded = pa.array(parts, pa.large_string()).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = {p: self._ids(p) for p in pieces if _beyond(p)}
        near = [p for p in pieces if p not in ids]
        for group in (near[at : at + PIECES_A_CALL] for at in range(0, len(near), PIECES_A_CALL)):
            ids.update(zip(group, self._piece_ids(group), strict=True))
        spread = _lists([ids[p] for p in pieces]).take(coded.indices)
        return pa.ListArray.from_arrays(spread.offsets.take(pa.array(ends)), spread.flatten())

    def _by_words(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of lower-case texts."""
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        at = pc.index_in(words, value_set=self.words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        places = at.fill_null(0).to_numpy().copy()
        places[new] = len(self.words) + np.arange(new.sum())
        new_ids = self._word_ids(words.filter(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
        ids = pa.concat_arrays([self.ids, new_ids]).take(pa.array(places))
        # The words of these texts are the last to be forgotten.
        idle = np.ones(len(self.words), bool)
        idle[places[~new]] = False
        self.words = _last(pa.concat_arrays([self.words.filter(pa.array(idle)), words]))
        self.ids = _last(pa.concat_arrays([self.ids.filter(pa.array(idle)), ids]))
        spread = ids.take(coded.indices)
        raw = memoryview(spread.flatten().to_numpy()).cast("B")
        ends = (4 * spread.offsets.to_numpy().astype(np.int64)[split.offsets.to_numpy()]).tolist()
        return (bytes(raw[a:b]) for a, b in itertools.pairwise(ends))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        plain = [self.by_words and not any(x in t for x in UNSAFE) and is_normalized("NFC", t) for t in texts]
        coded = self._by_words([t.lower() for t, p in zip(texts, plain, strict=True) if p])
        return [next(coded) if p else self._ids(t) for t, p in zip(texts, plain, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _beyond(word: str) -> bool:
    return not word.isascii() and max(word) > LAST_LATIN


def _lists(ids: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit ids as a column of lists."""
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
    flat = pa.Array.from_buffers(pa.uint32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def _last(rows: pa.Array) -> pa.Array:
    """The last rows, without the memory of those before."""
    return rows if len(rows) <= CACHE_WORDS else pa.concat_arrays([rows.slice(len(rows) - CACHE_WORDS)])


def in_sizes(rows: Iterable[tuple], size: int = BATCH_CHARS) -> Iterator[list[tuple]]:
    """Rows, whose last value is a text, in lists of about ``size`` characters."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[-1])
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    length = 1 + (values > 0xFF).view(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    quads = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    quads[: len(values)] = length - 1
    control = quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    used = np.arange(4, dtype=np.uint8) < length[:, None]
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


#: Lengths of the four values that each control byte describes.
LENGTHS = 1 + ((np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of a block: lengths by table lookup, then one gather of the data."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    value = np.zeros(n, np.uint32)
    for k in range(4):
        value |= padded[starts + k if k else starts].astype(np.uint32) << np.uint32(8 * k)
    return value & MASKS[lengths]


def encode_corpus(
    docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> None:
    """Write ``docs`` to ``path/blocks`` and ``path/ranks`` in ascending id order.

    The texts are tokenized once, in ranges of ids, and kept as blocks of raw ids with the
    id counts of every partition until the ranks of the whole corpus are known.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = slim.withColumn("_tie", F.crc32(F.encode("text", "UTF-8")))
    ranged = keyed.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(rows: Iterable[tuple]) -> Iterator[tuple]:
        """Blocks of raw ids, and at the end the partition's counts (one entry an id)."""
        coder, seen, before, block = WordCoder.of(tokenizer_path), np.zeros(0, np.int64), 0, 0
        ids, sizes, parts, held, part = [], [], [], 0, None

        def flush() -> tuple:
            nonlocal before, block, seen, held
            raw = np.frombuffer(b"".join(parts), "<u4")
            counts = np.bincount(raw, minlength=len(seen))
            counts[: len(seen)] += seen
            seen = counts
            small = raw.max() < 1 << 16
            out = (part, block, before, np.array(ids, "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), raw.astype("<u2").tobytes() if small else raw.tobytes(), small, None)
            before, block, held = before + len(raw), block + 1, 0
            ids.clear(), sizes.clear(), parts.clear()
            return out

        for group in in_sizes(rows):
            for (part, doc, _), text_ids in zip(group, coder.encode_all([row[-1] for row in group]), strict=True):  # noqa: B007 - the closure reads the last part
                raw = text_ids + end
                ids.append(NULL_ID if doc is None else doc)
                sizes.append(len(raw) // 4)
                parts.append(raw)
                held += sizes[-1]
                if held >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()
        if block:
            yield part, None, None, None, None, None, None, seen.astype("<i8").tobytes()

    raw_path = shared_path(spark, "raw-ids")
    raw_schema = "part int, block int, before long, doc_ids binary, lengths binary, ids binary, small boolean, counts binary"
    raw = map_rows(ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text"), tokenize, raw_schema, 1)
    raw.write.option("compression", "zstd").parquet(raw_path)
    raw = spark.read.schema(raw.schema).parquet(raw_path)

    def unfold(rows: Iterable[tuple]) -> Iterator[tuple]:
        total: Counter = Counter()
        for (counts,) in rows:
            n = np.frombuffer(counts, "<i8")
            total.update({int(i): int(n[i]) for i in np.flatnonzero(n)})
        yield from total.items()

    # At most one row per id of the vocabulary, whose size bounds what the driver and tasks hold.
    counts = map_rows(raw.where("counts is not null").select("counts"), unfold, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts.select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"), "id", "n").write.parquet(f"{path}/ranks")
    ranks = read_ranks(spark, path)
    rank_of = np.zeros(int(ranks.max(initial=0)) + 1, np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def code(rows: Iterable[tuple]) -> Iterator[tuple]:
        for part, block, before, doc_ids, lengths, ids, small in rows:
            control, data = pack(shared.value[np.frombuffer(ids, "<u2" if small else "<u4")])
            yield part, block, before, doc_ids, lengths, control, data

    blocks = raw.where("ids is not null").drop("counts")
    map_rows(blocks, code, BLOCK_SCHEMA, 1).write.option("compression", "zstd").parquet(f"{path}/blocks")
    drop_folder(spark, raw_path)


NULL_ID = -(1 << 63)
BLOCK_SCHEMA = "part int, block int, before long, doc_ids binary, lengths binary, control binary, data binary"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this job wrote, through Spark's own file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_ranks(spark: SparkSession, path: str) -> np.ndarray:
    """Ids by rank. Bounded by the tokenizer's vocabulary."""
    rows = spark.read.schema("rank int, id int, n long").parquet(f"{path}/ranks").orderBy("rank").select("id").toPandas()
    return rows["id"].to_numpy(np.uint32)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids`` (ids as 32-bit little-endian)."""
    return _decoded(spark, path, bytes, "ids binary", 1000)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents of the files.

    The checksums are taken where the ids are decoded: the ids do not leave the task, which
    needs one Python worker.
    """
    return _decoded(spark, path, zlib.crc32, "ids_crc32 long")


def _decoded(spark: SparkSession, path: str, of_ids: Callable[[bytes], object], column: str, size: int = OUT_ROWS) -> DataFrame:
    """Each document of the files with its place and what ``of_ids`` makes of its ids."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # One row per range partition of the writer, whatever the number of documents.
    sizes = map_rows(blocks.select("part", "before", "lengths"), _block_ends, "part int, end long").groupBy("part").agg(F.max("end").alias("_n"))
    base = sizes.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    id_of = spark.sparkContext.broadcast(read_ranks(spark, path))

    def decode(rows: Iterable[tuple]) -> Iterator[tuple]:
        for base, before, doc_ids, lengths, control, data in rows:
            n = np.frombuffer(lengths, "<i8")
            ids = id_of.value[unpack(control, data, int(n.sum()))].astype("<u4")
            at = 0
            for doc, size in zip(np.frombuffer(doc_ids, "<i8").tolist(), n.tolist(), strict=True):
                yield None if doc == NULL_ID else doc, base + before + at, size, of_ids(ids[at : at + size].tobytes())
                at += size

    placed = blocks.join(F.broadcast(base), "part").select("_base", "before", "doc_ids", "lengths", "control", "data")
    return map_rows(placed, decode, f"doc_id long, start long, n_tokens long, {column}", size)


def _block_ends(rows: Iterable[tuple]) -> Iterator[tuple]:
    for part, before, lengths in rows:
        yield part, before + int(np.frombuffer(lengths, "<i8").sum())
