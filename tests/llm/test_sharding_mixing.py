import itertools
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from funnelworks.llm.hilbert_sharding import curve_index, hilbert_shards, shard_bounds, write_shards
from funnelworks.llm.mixing import mix_sources, source_targets


def test_curve_visits_every_cell_once_by_unit_steps(spark):
    for n, bits in ((2, 3), (3, 2), (4, 1)):
        cells = list(itertools.product(range(1 << bits), repeat=n))
        names = [f"d{i}" for i in range(n)]
        df = spark.createDataFrame(cells, ", ".join(f"{x} int" for x in names))
        rows = df.select(*names, curve_index([F.col(x) for x in names], bits).alias("h")).collect()
        order = [tuple(r)[:n] for r in sorted(rows, key=lambda r: r["h"])]
        assert sorted(r["h"] for r in rows) == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in zip(order, order[1:], strict=False))


def check_layout(rows, docs, shards=16):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((d[0] is None, d[0] or 0) for d in docs)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
    counts = [len(by_shard.get(s, ())) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_shards_are_even_and_gapless(make_docs, words):
    docs = [(i, words(i, 1 + i % 40), "de" if i % 3 else "en", f"s{i % 4}") for i in range(101)]
    rows = hilbert_shards(make_docs(docs)).collect()
    check_layout(rows, docs)
    crc = {d[0]: zlib.crc32(d[1].encode()) for d in docs}
    assert all(r["text_crc32"] == crc[r["doc_id"]] and r["size"] == len(docs[r["doc_id"]][1]) + 1 for r in rows)
    # shards follow the curve
    order = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_shard_edge_cases(spark, make_docs):
    docs = [(1, None, None, None), (1, None, None, None), (2, "", "en", None), (2, "é" * 3, None, "a"), (None, "x", "en", "a"), (5, "long " * 50_000, "en", "a")]
    rows = hilbert_shards(make_docs(docs).withColumn("shard", F.lit("clash")).withColumn("_rank", F.lit(1))).collect()
    check_layout(rows, docs)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 1} == {(1, 0)}
    assert hilbert_shards(make_docs([])).count() == 0


def test_shards_of_a_hot_source(make_docs):
    docs = [(i, "same text", "en", "hot") for i in range(200)] + [(200 + i, f"t{i}", "en", "s") for i in range(50)]
    check_layout(hilbert_shards(make_docs(docs)).collect(), docs)


def test_shard_files_prune(spark, make_docs, words, tmp_dir):
    docs = make_docs([(i, words(i, 5 + i), ["en", "de", "fr", "es"][i % 4], f"s{i % 8}") for i in range(320)])
    write_shards(docs, tmp_dir + "/out")
    back = spark.read.parquet(tmp_dir + "/out")
    assert back.count() == 320 and back.select("shard").distinct().count() == 16
    bounds = shard_bounds(hilbert_shards(docs)).collect()
    # a filter on one source leaves most shards out
    assert sum(b["min_source"] <= 0 <= b["max_source"] for b in bounds) <= 6


def fixed_point(sizes, weights=(1, 2, 3), cap=3):
    """Share by weight, cut at the cap, share the excess again, until none is above."""
    names = sorted(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        target = {s: cap * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def test_targets_are_the_fixed_point(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, "d": 0, "e": 77}, {"a": 5}, {f"s{i:02}": (i * 37) % 101 for i in range(30)}):
        df = spark.createDataFrame(list(sizes.items()), "key string, source_size long")
        got = {r["key"]: r["target"] for r in source_targets(df).collect()}
        want = fixed_point(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mix_meets_targets(make_docs, words):
    docs = [(i, words(i, 1 + (i * 7) % 90), "en", None if i % 5 == 4 else f"s{'ab'[i % 2] if i % 3 else 'c'}") for i in range(400)]
    rows = mix_sources(make_docs(docs)).collect()
    again = mix_sources(make_docs(docs[::-1])).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {d[0]: d[3] for d in docs}
    size = {d[0]: len(d[1].split()) for d in docs}
    taken, sizes, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r["doc_id"]] or "~"  # after the others
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        sizes[s] += r["size"]
        target[s] = r["target"]
    want = fixed_point(dict(sizes))
    for s in want:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - want[s]) <= max(r["size"] for r in rows if (source[r["doc_id"]] or "~") == s) / 2


def test_larger_budgets_take_supersets(make_docs, words):
    docs = make_docs([(i, words(i, 20), "en", "ab"[i % 2]) for i in range(200)])
    less = {r["doc_id"]: r["copies"] for r in mix_sources(docs, weights=(1, 3)).collect()}
    more = {r["doc_id"]: r["copies"] for r in mix_sources(docs, weights=(2, 3)).collect()}
    assert all(more[i] >= less[i] for i in less if i % 2 == 0)


def test_mix_edge_cases(make_docs):
    assert mix_sources(make_docs([])).count() == 0
    docs = make_docs([(1, None, None, None), (2, "", "en", "a"), (None, "x y", "en", "a"), (3, "p q r", "en", "a"), (3, "p q r", "en", "a")])
    rows = mix_sources(docs.withColumn("key", F.lit(1)).withColumn("place", F.lit(1))).collect()
    assert len(rows) == 5
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert sum(r["taken"] for r in rows) == 8  # one source with words: its whole size
    empty = mix_sources(make_docs([(1, None), (2, " \t ")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2


def test_mix_places_rows_without_ids_apart(make_docs, words):
    docs = [(None, words(i, 20), "en", "ab"[i % 2]) for i in range(1000)] + [(7, words(i, 20), "en", "c") for i in range(400)]
    rows = mix_sources(make_docs(docs)).collect()
    for size in {r["source_size"] for r in rows}:
        own = [r for r in rows if r["source_size"] == size]
        sources = len({r["target"] for r in own})
        assert abs(sum(r["taken"] for r in own) - sum({r["target"] for r in own}) * (len(own) * 20 / size / sources)) <= 20 * sources
    blank = mix_sources(make_docs([(1, "", "en", "a"), (2, "a b", "en", "a"), (3, None, "en", "b")])).collect()
    assert {r["doc_id"]: r["copies"] for r in blank} == {1: 0, 2: 3 if len(blank) > 3 else 1, 3: 0}
