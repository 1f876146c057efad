import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from funnelworks.llm import lm_scoring
from funnelworks.llm.common import table
from funnelworks.llm.lm_scoring import score_documents
from funnelworks.llm.queries import op9_lm_scoring
from funnelworks.llm.toxicity import fit, score_toxicity, terms_of

SF = "/root/testdata/sf0.01"

# --- language-model scores


def brute_scores(docs, order, backoff=0.4):
    texts = [re.findall(r"\w+", (t or "").lower()) for _, t in docs]
    grams = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in texts]
    corpus = sum(grams, Counter())
    total = sum(map(len, texts))
    out = []
    for (doc, _), w, own in zip(docs, texts, grams, strict=True):
        score = 0.0
        for j in range(len(w)):
            left_out = 0
            for n in range(min(order, j + 1), 0, -1):
                g = tuple(w[j - n + 1 : j + 1])
                others = corpus[g] - own[g]
                if n == 1:
                    word = others / (total - len(w)) if others else backoff / total
                    score += left_out * math.log(backoff) + math.log(word)
                elif others:
                    score += left_out * math.log(backoff) + math.log(others / (corpus[g[:-1]] - own[g[:-1]]))
                    break
                left_out += 1
        out.append((doc, len(w), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(make_docs, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "BATCH_CHARS", 2000)
    monkeypatch.setattr(lm_scoring, "PARTITION_WORDS", 300)
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice("the of a Cat dog, ran. éa x y z".split()) for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "!!"), (503, "once"), (503, "once"), (504, "unseen words only here")]
    got = sorted((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in score_documents(make_docs(docs).withColumn("batch", F.lit(1)), order=order).collect())
    assert got == sorted((d, n, round(s, 6)) for d, n, s in brute_scores(docs, order))


def test_registered_query_scores_trigrams(spark, make_docs, tmp_path):
    docs = [(1, "a b c"), (2, "a b c"), (3, "x b d"), (4, "x b d"), (5, "once only here")]
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in op9_lm_scoring(spark, str(tmp_path)).collect())
    assert got == sorted((d, n, round(s, 6)) for d, n, s in brute_scores(docs, 3))
    assert got != sorted((d, n, round(s, 6)) for d, n, s in brute_scores(docs, 2))


def test_score_edge_cases(make_docs):
    assert score_documents(make_docs([])).count() == 0
    rows = score_documents(make_docs([(None, "a b"), (1, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["mean_log_score"] is None) for r in rows) == [(0, 2, False), (1, 0, True)]


def test_texts_are_stored_once_and_not_shuffled(spark, make_docs, monkeypatch):
    """Before: a second copy of the texts, 0.65 x the input, went through the shuffle to the scores."""
    monkeypatch.setattr(lm_scoring, "BATCH_CHARS", 300)
    monkeypatch.setattr(lm_scoring, "PARTITION_WORDS", 20)
    tables = {t.name for t in spark.catalog.listTables()}
    scores = score_documents(make_docs([(i, f"word{i} and word{i + 1}") for i in range(50)]))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange " in line]
    assert [c for line in moved for c in ("hashpartitioning(p#", "hashpartitioning(batch#") if c in line] == ["hashpartitioning(batch#", "hashpartitioning(p#"]
    assert len([line for line in moved if "BroadcastExchange" not in line]) == 2
    assert {t.name for t in spark.catalog.listTables()} == tables  # the name that the buckets are read by
    assert scores.count() == 50 and scores.where("n_words = 3").count() == 50


# --- toxicity


def test_terms_stay_within_words_and_slices():
    doc, term = terms_of(["ab cd", None, "", "abcdef", "x" * 9])
    assert set(doc.tolist()) == {0, 3, 4}
    own = {d: set(term[doc == d].tolist()) for d in (0, 3)}
    assert len(own[0]) == 2  # <ab> and <cd>
    assert len(own[3]) == 5 + 4
    long = "word " * 500_000 + "special"
    a, b = terms_of([long]), terms_of(["word special"])
    assert a[1].tolist() == b[1].tolist()


def test_machine_learns_a_pair_that_no_sum_expresses():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        noise = rng.choice(np.arange(2, 12), 3, replace=False)
        rows.append(np.array(sorted([*([0] if a else []), *([1] if b else []), *noise.tolist()]), np.int64))
        labels.append(int(a != b))  # no additive weights tell this
    m = fit(rows, np.array(labels), np.arange(12), steps=12_000)
    v = m.factors
    z = np.array([m.bias + m.weights[r].sum() + 0.5 * ((v[r].sum(axis=0) ** 2).sum() - (v[r] ** 2).sum()) for r in rows])
    assert ((z > 0) == np.array(labels, bool)).mean() > 0.95


def test_scores_tell_a_pair_whose_words_tell_nothing_alone(spark, make_docs):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(2400):
        a, b = i % 2, i // 2 % 2
        text = rng.sample(vocabulary, 6) + ["qumzorv"] * a + ["wyxtun"] * b
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(a != b)))
    got = {r["doc_id"]: r for r in score_toxicity(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    right = [got[i]["predicted"] == y for i, y in labels if got[i]["held_out"]]
    assert len(right) > 500 and np.mean(right) > 0.95


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None, :]).mean() + 0.5 * (toxic.score.to_numpy()[:, None] == clean.score.to_numpy()[None, :]).mean() > 0.85
    assert clean.predicted.mean() < 0.02 and toxic.predicted.mean() > 0.6


def test_labels_of_the_fold_are_not_learnt(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = sorted(map(tuple, score_toxicity(docs, labels).collect()))
    b = sorted(map(tuple, score_toxicity(docs, flipped).collect()))
    assert a == b
    assert all(held == (zlib.crc32(str(i).encode()) % 3 == 1) for i, held, *_ in a)


def test_toxicity_edge_cases(spark, make_docs):
    schema = "doc_id long, toxic int, text string"
    docs = make_docs([(None, "x"), (1, None), (1, None), (2, ""), (3, "insult " * 300_000)])
    rows = score_toxicity(docs, spark.createDataFrame([], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["score"], r["predicted"]) for r in rows) == [(0, 0.0, 0), (1, 0.0, 0), (1, 0.0, 0), (2, 0.0, 0), (3, 0.0, 0)]
    both = [(i, f"clean text number {i}") for i in range(1000, 1100)] + [(i, f"some idiotic text {i}") for i in range(2000, 2100)]
    labels = spark.createDataFrame([(i, int(i >= 2000), "t") for i, _ in both] + [(None, 1, "t"), (1000, None, "t")], schema)
    got = {r["doc_id"]: r for r in score_toxicity(make_docs([*both, (5, "an idiotic remark"), (6, None), (7, "a clean remark")]), labels).collect()}
    assert got[5]["predicted"] == 1 and got[6]["predicted"] == 0 and got[7]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert score_toxicity(make_docs([]), labels).count() == 0


# --- pipeline


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    sizes = [docs.count()]
    labels = table(spark, sf, "labels")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if name == "toxicity":
            toxic = docs.join(labels, "doc_id").where("toxic = 1").count()
            assert toxic < 0.25 * labels.where("toxic = 1").count()
            assert docs.join(labels, "doc_id").where("toxic = 0").count() >= 0.98 * labels.where("toxic = 0").count()
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]
    assert docs.count() > docs.select("doc_id").distinct().count()  # the mix repeats documents
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == docs.count()
    assert sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)


def test_pipeline_edge_rows(spark, make_docs, words):
    docs = make_docs([(1, None, None, None), (1, None, None, None), (2, "", "en", "a"), (None, words(1, 30), "en", "a"), (3, words(2, 30), "en", "b"), (4, words(2, 30), "de", "b")])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.count() >= 1, name
    empty = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "/root/testdata/sf0.001")
        assert empty.count() == 0


def test_pipeline_extra_columns_with_clashing_names(spark, make_docs, words):
    docs = make_docs([(i, words(i % 4, 30), "en", "ab"[i % 2]) for i in range(8)] + [(8, None, None, None)])
    clashes = ("copies", "_id", "_bad", "_gone", "_text", "_copy", "__copies", "size", "taken", "class_id", "node", "text_hash", "item_id", "part", "start")
    wide = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in clashes])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, wide = stage(spark, docs, SF).cache(), stage(spark, wide, SF).cache()
        assert docs.count() and wide.columns[-len(clashes) :] == list(clashes), name
        assert sorted(map(repr, docs.collect())) == sorted(map(repr, wide.select(docs.columns).collect())), name
        assert wide.where(F.col("copies") != F.concat(F.lit("copies"), F.col("doc_id").cast("string"))).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted(map(tuple, last(spark, docs, SF).collect())) == sorted(map(tuple, last(spark, wide, SF).collect()))


def test_stages_leave_no_tables_behind(spark, tmp_path):
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))

    def files():
        return sum(p.suffix == ".parquet" or p.name.startswith("part-") for p in folder.rglob("*") if p.is_file())

    before, docs = files(), table(spark, SF, "documents").limit(300)
    docs.write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert corpus_pipeline.stored_elsewhere(docs, corpus_pipeline._left)
    lazy = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    assert not corpus_pipeline.stored_elsewhere(lazy, corpus_pipeline._left)
    last = sum(1 for f in corpus_pipeline._left for p in Path(f.removeprefix("file:")).rglob("part-*") if p.suffix != ".crc")
    assert files() <= before + 2 * last + 8
