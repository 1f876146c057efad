"""A corpus pipeline of five operators, from raw documents to token files.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as
Parquet and rereads as the next stage's documents. The stages up to the mix return the
columns of documents; a document that a stage rejects is gone for the rest.

What a stage writes on the way (tables, checkpoints) is read until its result is written. It is
deleted when the next stage starts from a stored table, or by ``run`` once the result is stored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm.common import store, table
from funnelworks.llm.decontamination import contaminated
from funnelworks.llm.jaccard_join import similarity_classes
from funnelworks.llm.mixing import mix_sources
from funnelworks.llm.queries import tokenizer_file
from funnelworks.llm.token_output import encode_corpus, read_checksums
from funnelworks.llm.toxicity import score_toxicity
from funnelworks.session import drop_tables, noting_tables, shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Folders that the last stage wrote on the way.
_left: list[str] = []


def stored_elsewhere(docs: DataFrame, folders: list[str]) -> bool:
    """Whether a DataFrame reads stored files alone, and none of some folders."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    if any(leaves.apply(i).nodeName() != "LogicalRelation" for i in range(leaves.size())):
        return False
    names = [f.split("/")[-1] for f in folders]
    return not any(name in file for file in docs.inputFiles() for name in names)


def tidy(stage: Stage) -> Stage:
    """A stage that deletes what the one before has left, once that one's result is stored."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left and stored_elsewhere(docs, _left):
            drop_tables(spark, _left)
        with noting_tables() as paths:
            out = stage(spark, docs, sf_dir)
            _left.extend(paths)
        return out

    return run_stage


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names behind underscores, as many as it takes to meet no column of ``docs``."""
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    return [mark + n for n in names]


@tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    The decision is by id: of rows with one id, all go if one is toxic. Rows with a NULL id
    are judged together in the same way.
    """
    (bad,) = unused(docs, "bad")
    scores = score_toxicity(docs, table(spark, sf_dir, "labels"))
    toxic = scores.where("predicted = 1").select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(toxic, F.col("doc_id").eqNullSafe(F.col(bad)), "left_anti")


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id.

    Rows with the same id are kept or dropped together, by their first class. Rows with a
    NULL id are kept, as nothing tells them apart.
    """
    (gone,) = unused(docs, "gone")
    classes = similarity_classes(docs).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    copies = classes.where("class_id <> doc_id").select(F.col("doc_id").alias(gone))
    return docs.join(copies, F.col("doc_id") == F.col(gone), "left_anti")


@tidy
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items (told by id and text)."""
    leak, leak_text = unused(docs, "id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaks = found.select(F.col("doc_id").alias(leak), F.col("text_hash").alias(leak_text)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(leak)) & (F.xxhash64("text") == F.col(leak_text))
    return docs.join(leaks, same, "left_anti")


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, each as many times as it takes them (told by id and text)."""
    own, own_text, times = unused(docs, "id", "text", "copies")
    mixed = mix_sources(docs).where("copies > 0")
    taken = mixed.groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(own_text)).agg(F.max("copies").alias(times))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(own_text))
    kept = docs.join(taken, same)
    repeated = kept.select(*[F.col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), times)).alias(times))
    return repeated.drop(times)


@tidy
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; returns what the files hold of each document."""
    path = shared_path(spark, "tokens")
    encode_corpus(docs, tokenizer_file(), path)
    return read_checksums(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix),
    ("token_output", write_tokens),
]

# Neither the fitted scores nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with noting_tables() as written:
            docs = store(stage(spark, docs, sf_dir), name)
        drop_tables(spark, _left)
        drop_tables(spark, before)
        before = written
    return docs
