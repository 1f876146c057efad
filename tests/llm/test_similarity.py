import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelworks.llm import jaccard_join, topk_search
from funnelworks.llm.components import connected_components
from funnelworks.llm.decontamination import RADIUS, ItemIndex, contaminated, fingerprints
from funnelworks.llm.jaccard_join import chance_of_finding, runs_for, similarity_classes
from funnelworks.llm.shingles import ngrams, shingles, word_hashes
from funnelworks.llm.topk_search import top_k

# --- words and shingles


def test_words_equal_the_regular_expression():
    texts = ["One two_2 THREE", "", None, "É é-è ß9 ·x", "a" * 3_000_000 + " b", "x " * 700_000, " \n", "日本語 テキスト"]
    hashes, ends = word_hashes(texts)
    split = np.split(hashes, ends[:-1])
    seen = {}
    for text, own in zip(texts, split, strict=True):
        words = re.findall(r"\w+", (text or "").lower())
        assert len(words) == len(own)
        for w, h in zip(words, own.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def sets_of(texts):
    hashes, ends = word_hashes(texts)
    return [set(shingles(w).tolist()) for w in np.split(hashes, ends[:-1])]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


# --- components


def test_components_of_paths_rings_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(200, 200 + i) for i in range(1, 50)] + [(-5, 999)]
    rng = random.Random(4)
    name = {i: rng.getrandbits(62) for e in edges for i in e}
    named = [(name[a], name[b]) for a, b in edges]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(named, "a long, b long")).collect()}
    groups = [range(61), range(100, 107), range(200, 250), (-5, 999)]
    assert got == {name[i]: min(name[j] for j in g) for g in groups for i in g}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- similarity join


def edited(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "q" + str(rng.randrange(10**6))
    return " ".join(words)


def brute_classes(docs):
    sets = sets_of([t for _, t in docs])
    near = [[j for j in range(len(docs)) if j != i and jaccard(sets[i], sets[j]) >= 0.8] for i in range(len(docs))]
    out, done = {}, set()
    for i in range(len(docs)):
        if i in done:
            continue
        todo, own = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in own:
                    own.add(j)
                    todo.append(j)
        done |= own
        for j in own:
            out[docs[j][0]] = min(docs[k][0] for k in own), len(own), len(near[j])
    return out


@pytest.fixture(scope="module")
def near_docs():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = []
    for g in range(25):
        base = " ".join(word() for _ in range(rng.randint(30, 200)))
        docs += [edited(base, rng, rng.randint(0, 5)) for _ in range(rng.randint(1, 6))]
    shared = " ".join(word() for _ in range(60))
    docs += [f"{shared} " + " ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(60)]
    docs += [docs[0]] * 3 + ["two words", "Two, words.", "", "... !", None]
    return [(i * 7 % 1009, t) for i, t in enumerate(docs)]


def compare(rows, docs):
    want = brute_classes(docs)
    got = {r["doc_id"]: (r["class_id"], r["class_size"], r["n_links"]) for r in rows}
    assert got == want


def test_join_equals_brute_force(make_docs, near_docs):
    compare(similarity_classes(make_docs(near_docs)).collect(), near_docs)


def test_large_buckets_are_split_and_compared_in_blocks(make_docs, near_docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIMIT", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 3)
    compare(similarity_classes(make_docs(near_docs)).collect(), near_docs)


def test_a_large_group_emits_no_pairs(make_docs):
    rng = random.Random(1)
    base = " ".join("w%d" % rng.randrange(10**6) for _ in range(300))
    docs = [(i, edited(base, rng, 1)) for i in range(400)]
    rows = similarity_classes(make_docs(docs)).collect()
    assert {r["class_id"] for r in rows} == {0} and len(rows) == 400
    assert all(r["n_links"] == 399 for r in rows)


def test_join_edge_cases(make_docs):
    assert similarity_classes(make_docs([])).count() == 0
    text = "one two three four five six"
    rows = similarity_classes(make_docs([(5, text), (5, text), (None, text), (3, text), (9, None)]).withColumn("id", F.lit(0)).withColumn("node", F.lit(0))).collect()
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in rows)
    assert got == [(3, 3, 2), (5, 3, 2), (9, 9, 0), ((1 << 63) - 1, 3, 2)]


def test_runs_reach_the_recall():
    assert 1 - (1 - chance_of_finding(0.8)) ** runs_for(0.999) >= 0.999
    assert chance_of_finding(0.95) > chance_of_finding(0.8)


# --- decontamination


def brute_leaks(docs, items):
    out = {}
    for d, text in docs:
        w = re.findall(r"\w+", (text or "").lower())
        for i, item in items:
            v = re.findall(r"\w+", (item or "").lower())
            if not v:
                continue
            n = min(5, len(v))
            want = Counter(tuple(v[k : k + n]) for k in range(len(v) - n + 1))
            for s in range(max(len(w) - len(v), 0) + 1):
                own = w[s : s + len(v)]
                have = Counter(tuple(own[k : k + n]) for k in range(len(own) - n + 1))
                both = sum((want & have).values())
                alike = both / (sum(want.values()) + sum(have.values()) - both) if both else 0
                if alike >= 0.8 and alike > out.get((d, i), (0,))[0] + 1e-12:
                    out[d, i] = alike, s, len(own)
    return out


def test_leaks_equal_brute_force(spark, make_docs, words):
    items = [(i, words(1000 + i, 12 + i)) for i in range(30)] + [(50, "three word item"), (51, None), (52, " ."), (53, "repeat " * 20), (54, words(1003, 15))]
    docs = [(i, words(i, 40)) for i in range(20)]
    rng = random.Random(0)
    for i in range(30):
        leak = items[i][1].split()
        if i % 3 == 1:
            leak[-1] = "changed"
        if i % 3 == 2:
            leak[len(leak) // 2] = "changed"  # below the threshold for short items
        docs.append((100 + i, words(i, 15) + "; " + " ".join(leak).upper() + ", " + words(i + 7, rng.randrange(20))))
    docs += [(200, "a Three word, ITEM."), (201, None), (202, ""), (203, " ".join(items[29][1].split()[:36])), (204, "repeat " * 50), (205, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(make_docs(docs).withColumn("item_id", F.lit(1)), bench).collect()}
    want = brute_leaks(docs, items)
    assert got.keys() == want.keys()
    for k, (alike, _, n) in want.items():
        assert abs(got[k]["similarity"] - alike) < 1e-9 and got[k]["n_words"] == n


def test_tables_yield_all_fingerprints_in_the_radius():
    rng = np.random.default_rng(0)
    items = [rng.integers(0, 2**63, 20).astype(np.uint64) for _ in range(50)]
    index = ItemIndex(list(range(50)), items)
    windows = index.prints[rng.integers(0, 50, 400)].copy()
    for w in windows:  # flip up to 40 of the 128 bits
        for b in rng.permutation(128)[: rng.integers(0, 41)]:
            w[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    at, item = index.within(windows)
    apart = np.bitwise_count(windows[:, None, :] ^ index.prints[None, :, :]).sum(axis=2)
    assert set(zip(at.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(apart <= RADIUS)), strict=True))


def test_fingerprint_counts_repeats():
    g = ngrams(word_hashes(["a b c d e f g a b c d e"])[0], 5)
    both = fingerprints(g, np.array([0, 0]), np.array([len(g), len(g)]))
    assert (both[0] == both[1]).all()


def test_leak_edge_cases(spark, make_docs, words):
    bench = spark.createDataFrame([(1, words(5, 20)), (1, words(5, 20)), (2, words(5, 20)), (None, words(6, 20))], "item_id long, text string")
    docs = make_docs([(4, words(5, 20)), (4, words(5, 20)), (None, "x " + words(6, 20))])
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in contaminated(docs, bench).collect())
    assert got == [(0, 0), (4, 1), (4, 2)]
    assert contaminated(docs, bench.limit(0)).count() == 0
    assert contaminated(make_docs([]), bench).count() == 0


# --- exact search


def brute_top(rows, k=10, every=100):
    ok = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for q, a in ok:
        if q % every:
            continue
        best = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, score int"


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.2, (12, 16))
    rows = [(int(i), (centres[i % 12] + rng.normal(0, 0.05, 16)).astype(np.float32).tolist()) for i in rng.permutation(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # a very common vector
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS).repartition(5)
    assert sorted(map(tuple, top_k(df).collect())) == brute_top(rows)


def test_search_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (1, [0.5]), (2, []), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-1.0, 0.25]), (8, [1.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS)
    assert sorted(map(tuple, top_k(df).collect())) == brute_top(rows)
    assert top_k(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(100, [3e38, 1.0], 1), (1, [1.0, 1.0], 1)], VECTORS)
    assert [(r["query_id"], r["vec_id"]) for r in top_k(huge).collect()] == [(100, 1)]


def test_search_of_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 40)
    rng = random.Random(8)
    rows = [(0, [1.0]), (1, [300000.0]), (2, [400000.0]), (3, [262144.0])]
    rows += [(i, [float(np.float32(rng.gauss(0, rng.choice([1, 1e6])))) for _ in range(6)]) for i in range(100, 400)]
    rows += [(400, rows[9][1]), (401, rows[9][1]), (500, [1e9] * 6), (501, [None, 1e9]), (502, [float("inf")])]
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS).repartition(4)
    got = sorted(map(tuple, top_k(df).collect()))
    top = (1 << 63) - 1
    want = [(q, r, i, max(min(s, top), -top - 1)) for q, r, i, s in brute_top(rows)]
    assert [g for g in got if g[0] == 0] == [w for w in want if w[0] == 0]
    assert [g for g in got if abs(g[3]) < top] == [w for w in want if abs(w[3]) < top]


def test_rows_without_ids_are_read_again_once_each(spark, make_docs, words, monkeypatch):
    texts = [words(i, 40) for i in range(60)]
    near = [t + " extra" for t in texts]
    docs = make_docs([(None, t) for t in texts + near] + [(5, t) for t in texts[:20]])
    read = spark.sparkContext.accumulator(0)
    plain = jaccard_join.class_key

    def counted(s):
        read.add(1)
        return plain(s)

    monkeypatch.setattr(jaccard_join, "class_key", counted)
    rows = similarity_classes(docs).collect()
    # once to sketch each row, and once more for each different text of a group
    assert read.value <= 140 + 140
    assert sorted({r["n_text_links"] for r in rows}) == [1]
