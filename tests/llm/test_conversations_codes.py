import itertools
import random
import re
from hashlib import md5, sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from funnelworks.llm import chat_format, vector_codes
from funnelworks.llm.chat_format import escape, format_chats, log_of, parse, read_back, replay, turn_text, unescape
from funnelworks.llm.conversation_repair import SLOTS, Conversation, Repair, damage, repair
from funnelworks.llm.vector_codes import Assignment, encode_vectors, tree_order

TALK = "conv_id long, turn long, role string, text string"

# --- conversation repair


def all_repairs(rows):
    """Cost, audit and output of every edit of a short conversation, by enumeration."""

    def edits(role, text, must_go, cut_off):
        yield "D", 4, None
        if not must_go:
            extra = 3 if cut_off else 0
            yield "K", extra, (role, text)
            for given in ("user", "assistant"):
                yield "R", 3 + extra, (given, text)

    gaps = [c for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]
    for choice in itertools.product(*(edits(*r) for r in rows)):
        for made in itertools.product(gaps, repeat=len(rows) + 1):
            out, audit, cost = [], "", 0
            for n, gap in enumerate(made):
                out += [(g, "") for g in gap]
                audit += "I" * len(gap)
                cost += 3 * len(gap)
                if n < len(choice):
                    letter, paid, row = choice[n]
                    audit, cost = audit + letter, cost + paid
                    out += [row] if row else []
            if all(r for r, _ in out) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
                yield cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def test_path_equals_enumeration():
    rng = random.Random(3)
    for _ in range(120):
        rows = []
        for n in range(rng.randint(0, 3)):
            must_go = rng.random() < 0.3
            rows.append((rng.choice(["user", "assistant", "system", "tool", ""]), f"t{n}", must_go, not must_go and rng.random() < 0.3))
        found = Repair()
        for row in rows:
            found.take(*row)
        cost, audit, out = min(all_repairs(rows))
        assert found.result() == (cost, audit, sha256(out.encode()).hexdigest()), rows


def plain_repair(rows):
    """The same by tuples of cost, audit and output for every state, without integers."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    made = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def inserts(best):
        for _ in range(2):
            for s, (cost, audit, out) in list(best.items()):
                role, t = made[s]
                way = (cost + 3, audit + "I", (*out, f"{role}:"))
                best[t] = min(best.get(t, way), way)
        return best

    best = {0: (0, "", ())}
    for role, text, must_go, cut_off in rows:
        new = {}
        for s, (cost, audit, out) in inserts(best).items():
            ways = [(s, (cost + 4, audit + "D", out))]
            if not must_go:
                extra = 3 if cut_off else 0
                if (t := step.get((s, role[:1]))) is not None:
                    ways.append((t, (cost + extra, audit + "K", (*out, f"{role}:{text}"))))
                given, t = made[s]
                ways.append((t, (cost + 3 + extra, audit + "R", (*out, f"{given}:{text}"))))
            for t, way in ways:
                new[t] = min(new.get(t, way), way)
        best = new
    cost, audit, out = min(v for s, v in inserts(best).items() if s in (0, 3))
    return cost, audit, sha256("\n".join(out).encode()).hexdigest()


def test_long_conversations_keep_small_integers():
    rng = random.Random(5)
    for n in (SLOTS - 1, SLOTS, SLOTS + 1, 5 * SLOTS, 997):
        rows = [(rng.choice(["user", "assistant", "user", "assistant", "system"]), f"t{i}", rng.random() < 0.1, False) for i in range(n)]
        found = Repair()
        for row in rows:
            found.take(*row)
            assert max(b[0].bit_length() for b in found.best if b) < 10 * SLOTS + 32
        assert found.result() == plain_repair(rows)


def test_repair_of_odd_rows(spark):
    rows = [
        (1, None, "user", "a null turn."), (1, 5, "assistant", "yes."), (1, 3, "user", "why?"), (1, 3, "user", "why?"),
        (2, 1, None, None), (2, 9, "", "no role."), (3, 0, "assistant", "\t\v "), (None, 1, "user", "cut off"), (None, 2, "assistant", "ok."),
        (4, -(1 << 63), "user", "a."), (4, (1 << 63) - 1, "assistant", "b."),
    ]
    found = {r["conv_id"]: r for r in repair(spark.createDataFrame(rows, TALK).selectExpr("*", "1 AS weight", "2 AS kind")).collect()}
    one = found[1]
    assert (one["gaps"], one["duplicate"], one["illegal"], one["audit"], one["cost"]) == (1, 1, 2, "KIKDK", 7)
    two = found[2]
    assert (two["blank"], two["truncated"], two["audit"], two["cost"]) == (1, 0, "DD", 8)
    assert two["repaired_sha256"] == sha256(b"").hexdigest()
    assert (found[3]["blank"], found[3]["audit"]) == (1, "D")
    none = found[None]
    assert (none["truncated"], none["audit"], none["cost"]) == (1, "KK", 3)
    assert none["repaired_sha256"] == sha256(b"user:cut off\nassistant:ok.").hexdigest()
    assert found[4]["gaps"] == (1 << 63) - 1


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in (0, 1, None)] + [(None, 1, None, None)]
    got = damage(spark.createDataFrame(rows, TALK)).collect()
    assert {r["conv_id"] for r in got} == {r[0] for r in rows}
    for conv, turn, role, text in rows:
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = [r for r in got if (r["conv_id"], r["turn"]) == (conv, turn)]
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind < 2 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        assert [(r["role"], r["text"], r["there"]) for r in own] == [(role, text, kind != 0)] * (2 if kind == 3 else 1)


def test_repair_of_nothing(spark):
    assert repair(damage(spark.createDataFrame([], TALK))).count() == 0
    gone = spark.createDataFrame([(8, 0, "user", "x.", False)], TALK + ", there boolean")
    assert tuple(repair(gone).first()) == (8, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())


def test_a_conversation_of_many_rows_holds_no_texts():
    talk = Conversation(1)
    for n in range(3000):
        talk.add(n, "user" if n % 2 == 0 else "assistant", f"text {n} " + "x" * 1000 + ".")
    assert talk.row()[6:8] == (0, "K" * 3000)


# --- vector codes


def nearest(points, entries):
    away = ((points[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    return np.array([min(range(len(entries)), key=lambda j, i=i: (away[i, j], j)) for i in range(len(points))])


@pytest.mark.parametrize(
    ("n", "d", "k", "scale"),
    [(1, 4, 1, 100), (5, 3, 2, 3), (2000, 4, 64, 100), (700, 4, 64, 2), (77, 1, 10, 5), (300, 8, 33, 1 << 24), (50, 2, 7, 1 << 40)],
)
def test_two_trees_assign_as_all_distances(n, d, k, scale):
    rng = np.random.default_rng(n)
    points, entries = rng.integers(-scale, scale, (n, d)), rng.integers(-scale, scale, (k, d))
    found, want = Assignment(points, tree_order(points, vector_codes.LEAF), entries), nearest(points, entries)
    sums = np.zeros((k, d), object)
    np.add.at(sums, want, points.astype(object))
    assert (found.code == want).all()
    assert (found.counts == np.bincount(want, minlength=k)).all()
    assert (found.sums == sums).all()


def test_trees_prune():
    rng = np.random.default_rng(1)
    points = np.concatenate([c + rng.integers(-20, 20, (128, 4)) for c in rng.integers(-2000, 2000, (32, 4))])
    found = Assignment(points, tree_order(points, vector_codes.LEAF), points[::64])
    assert found.computed < 0.15 * len(points) * 64


def brute_codes(rows):
    """Codes of (id, vector, label) rows with Python's integers."""
    import math
    from fractions import Fraction

    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max(len(r[1]) for r in kept) // 16) * 16
    whole = [[math.floor(Fraction(x) * 256) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:64]
    step = width // 16

    def assign(books):
        out = []
        for v in whole:
            code = []
            for p in range(16):
                part = v[p * step : (p + 1) * step]
                away = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in books[p]]
                code.append((away.index(min(away)), min(away)))
            out.append(code)
        return out

    books = [[whole[i][p * step : (p + 1) * step] for i in first] for p in range(16)]
    for _ in range(2):
        codes = assign(books)
        for p in range(16):
            for e in range(len(first)):
                own = [v[p * step : (p + 1) * step] for v, c in zip(whole, codes, strict=True) if c[p][0] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign(books)
    digest = sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for _, d in c) for c in codes]
    labels = {}
    for r, e in zip(kept, errors, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    top = (1 << 63) - 1
    return [
        (r[0], r[2], "".join(f"{i:02x}" for i, _ in c), min(e, top), min(labels[r[2]], top), digest)
        for r, c, e in zip(kept, codes, errors, strict=True)
    ]


def codes_of(spark, rows, kind="double"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 AS code", "2 AS _label")
    return [tuple(r) for r in encode_vectors(frame).collect()]


def in_order(rows):
    return sorted(rows, key=repr)


def test_codes_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i * 3 % 400, [rng.gauss(0, 1) for _ in range(32)], rng.choice([1, 2, None])) for i in range(400)]
    rows += [(7, None, 1), (8, [1.0] * 31 + [None], 1), (9, [float("nan")] * 32, 1), (10, [float("-inf")] * 32, 2)]
    rows += [(None, rows[5][1], 1), (3, rows[5][1], None), (3, rows[5][1], None)]
    assert in_order(codes_of(spark, rows)) == in_order(brute_codes(rows))


def test_codes_of_wide_and_uneven_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_VALUES", 320)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 10**size) for _ in range(rng.choice([0, 3, 17, 20]))], None) for i, size in enumerate([0, 1, 20] * 30)]
    rows.append((500, [1e300, -1e300], 1))
    assert in_order(codes_of(spark, rows)) == in_order(brute_codes(rows))


def test_codes_of_few_and_no_vectors(spark):
    assert codes_of(spark, [(1, [0.5] * 16, 1)]) == [(1, 1, "00" * 16, 0, 0, brute_codes([(1, [0.5] * 16, 1)])[0][-1])]
    assert codes_of(spark, []) == []
    assert codes_of(spark, [(1, None, 1)]) == []
    assert codes_of(spark, [(1, [], 1), (2, [], None)]) == brute_codes([(1, [], 1), (2, [], None)])


# --- chat formatting

CONTROL = st.lists(st.sampled_from(["#", "##", "###", "</turn>", "</turn", "turn>", "<", "/", "\\", "\n", "n", "é", " "]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(CONTROL, CONTROL | st.text(max_size=8)), max_size=5))
def test_template_round_trip(turns):
    document = "".join(turn_text(role, text)[0] for role, text in turns)
    assert [(r, t) for r, t, _, _ in parse(document)] == turns
    for role, text in turns:
        assert "###" not in escape(text) and "</turn>" not in escape(text)
        assert unescape(escape(text)) == text
        whole, start = turn_text(role, text)
        assert unescape(whole[start : -len(chat_format.END) - 1]) == text


def test_replay_of_events():
    events = [
        (0, "open", "assistant", None, None, None), (1, "delta", None, "draft", None, None), (2, "regenerate", None, None, None, None),
        (3, "delta", None, "Hxllo", None, None), (3, "delta", None, "Hxllo", None, None), (4, "edit", None, "e", 1, 1),
        (5, "delta", None, " there", None, None), (6, "edit", None, "!", 99, 5), (7, "edit", None, "", 0, 0),
    ]
    assert replay(events) == ("assistant", "Hello there!")
    assert replay([(1, "delta", None, None, None, None)]) == ("", "")


def wanted(rows):
    out = {}
    from hashlib import md5

    key = lambda r: (r[1] is not None, r[1] or 0, md5(f"{r[2] or ''}\n{r[3] or ''}".encode()).hexdigest())
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        learnt = "".join(t for r, t in own if r == "assistant")
        out[conv] = (
            len(own), len(learnt), sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(),
            sha256(learnt.encode()).hexdigest(), sum(len(turn_text(r, t)[0]) for r, t in own),
        )
    return out


def digests(frame):
    return {r["conv_id"]: tuple(r)[1:] for r in read_back(frame).collect()}


ODD = [
    (1, 1, "assistant", "two ### </turn> \\"), (1, 0, "user", "é" * 2500), (1, 0, "user", "é" * 2500), (1, 0, "user", ""), (2, None, None, None),
    (None, 3, "assistant", "x\ny"), (None, None, "assistant", "</turn>\n### user\n"), (3, 0, "a\nb\\n###", "t"), (3, 1, "Assistant", "no loss"),
]


def test_documents_of_odd_rows(spark):
    frame = spark.createDataFrame(ODD, TALK).selectExpr("*", "1 AS part", "2 AS message", "'x' AS kind")
    assert digests(format_chats(log_of(frame))) == wanted(ODD)
    shuffled = log_of(frame).unionByName(log_of(frame)).repartition(7)
    assert digests(format_chats(shuffled)) == wanted(ODD)
    assert read_back(format_chats(log_of(spark.createDataFrame([], TALK)))).count() == 0


def test_a_long_conversation_in_parts(spark, monkeypatch):
    rows = [(5, n, ("user", "assistant")[n % 2], f"turn {n} " + "y" * (n % 90)) for n in range(600)] + ODD
    frame = spark.createDataFrame(rows, TALK).repartition(5)
    parts = chat_format.render(chat_format.fold(log_of(frame)), part_chars=2000)
    documents = chat_format.store(parts, "documents")
    assert documents.where("conv_id = 5").count() > 8
    assert documents.selectExpr("max(length(document)) AS n").first()["n"] < 6000
    assert digests(documents) == wanted(rows)


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_vector_codes", "op13_chat_formatting"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from funnelworks.llm.queries import ORACLES, QUERIES

    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(got.columns) == columns
    assert in_order(tuple(r[c] for c in columns) for r in got.collect()) == in_order(tuple(r[i] for i in at) for r in want.fetchall())
