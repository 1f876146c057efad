import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from funnelworks.llm import html_extraction, token_output
from funnelworks.llm.html_extraction import extract_text, main_text
from funnelworks.llm.line_dedup import dedup_lines
from funnelworks.llm.queries import tokenizer_file
from funnelworks.llm.token_output import END_ID, WordCoder, encode_corpus, pack, read_checksums, read_corpus, unpack

# --- HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";if (a<b) {}</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu, one.</a></li></ul></nav><!-- <p>note</p> -->
<div class="ad">Buy, now, please.</div><div id="cookie-notice"><p>We use cookies, yes.</p></div>
<div class="layout"><aside><p>A long sidebar, with much text, and more, and more, and more of it.</p></aside>
<article><h1>Head</h1><p><b>First &amp; best.<br><p>Sec&eacute;nd&nbsp;one,   with a <a href=x>link</a>.</p><p>Ok</p>
<form><p>Mail, please.</p><input></form><ul><li>one<li>two</ul></article>
<section class="comments"><p>Great, I like it, really, very, very much, more than the article itself, I must say.</p></section>
</div><footer>&copy; me.</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "Head First & best. Secénd one, with a link. Ok one two"


def test_page_without_article_tag():
    body = "".join(f"<p>Paragraph {i}, with some text, and a stop.</p>" for i in range(6))
    html = f"<body><div class=menu><a href=1>a</a><a href=2>b</a></div><div class=text><h2>Title</h2>{body}<p>End</p></div><div class='reply-list'><p>Nice, very nice, indeed.</p></div></body>"
    assert main_text(html) == "Title " + " ".join(f"Paragraph {i}, with some text, and a stop." for i in range(6)) + " End"


def test_article_holds_all_content_blocks():
    long = [f"Paragraph {i}, with some text, and a stop." for i in range(8)]
    ps = "".join(f"<p>{x}</p>" for x in long)
    assert main_text(f"<body><div>Menu</div><article><h1>T</h1><div>{ps}</div></article></body>") == " ".join(["T", *long])
    for outer in ("article", "main", "div"):
        parts = f"<{outer}><section>{''.join(f'<p>{x}</p>' for x in long[:6])}</section><section>{''.join(f'<p>{x}</p>' for x in long[6:])}</section></{outer}>"
        assert main_text(f"<body>{parts}</body>") == " ".join(long), outer
    for group, item in (("ul", "li"), ("ol", "li"), ("dl", "dd"), ("table", "tr")):
        items = "".join(f"<{item}>{x}</{item}>" for x in long)
        assert main_text(f"<body><article><p>First, a word.</p><{group}>{items}</{group}><p>Last, a word.</p></article></body>") == " ".join(["First, a word.", *long, "Last, a word."]), group


def test_a_class_word_does_not_empty_a_page():
    long = [f"Paragraph {i}, with some text, and a stop." for i in range(8)]
    ps = "".join(f"<p>{x}</p>" for x in long)
    extras = "<div class=menu><a href=1>a</a></div><div class='share'>Share this, now.</div><div class='comment-list'><p>Nice, very nice.</p></div>"
    opens = ("div class='content has-sidebar'", "div class='layout no-sidebar'", "div id='main' class='with-sidebar'", "article class='comments-open'", "section id='discussion'", "div class='search'", "div class='sidebar-wrap'")
    for opening in opens:
        tag = opening.split()[0]
        assert main_text(f"<body><{opening}>{ps}</{tag}>{extras}</body>") == " ".join(long), opening
        assert main_text(f"<body><{opening}>{ps}{extras}</{tag}></body>") == " ".join(long), opening
    assert main_text("".join(f"<div class='response'>{x}</div>" for x in long)) == " ".join(long)
    assert main_text(f"<div><span class='notice'>{long[0]}</span></div>") == long[0]
    assert main_text(f"<main>{ps}<section class='comments'>{ps[: len(ps) * 5 // 8]}</section></main>") == " ".join(long)


def test_unclosed_elements_do_not_hide_the_article():
    for html in ("<html><head><title>x</title><body><p>whole article</p>", "<head><title>x</title><p>whole article</p>", "<head><meta charset=x>whole article", "<head><noscript><link><body><p>whole article</p></body>", "<head><title>x</title><b>whole</b> article"):
        assert main_text(html) == "whole article", html
    for left_out in ("header", "nav", "form", "aside", "footer", "div role=navigation"):
        for tag in ("article", "main", "div class=content"):
            assert main_text(f"<body><{left_out}><i>Menu</i><{tag}><p>Whole, article.</p></{tag.split()[0]}>".replace("</div>", "")) == "Whole, article.", (left_out, tag)
        shut = left_out.split()[0]
        assert main_text(f"<body><{left_out}><article><p>Not, this.</p></article></{shut}><article><p>Whole, article.</p></article></body>") == "Whole, article.", left_out
        assert main_text(f"<body><{left_out}><i>Menu</i><article><p>Whole, article.</p><header>By me.</header></article></body>") == "Whole, article.", left_out
    assert main_text("<nav><article>a, b." + "<article>a, b." * 20_000 + "</nav>") == ""


def test_odd_pages():
    for html, want in ((None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("a < b & c", "a < b & c"), ("</div>x", "x"), ("<script>p", ""), ("<p>x<!-- ", "x"), ("<nav>only menu</nav>", "")):
        assert main_text(html) == want
    deep = "<div>" * 3000 + "<p>deep, text.</p>"
    assert main_text(deep) == "deep, text."


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "<br/>", "<li>", "<td>", "<a href='x'>", "</a>", "t, u.", " ", "<!--", "-->", "<script>", "</script>", "<", ">", '"', "&amp;", "<article>", "<nav>", "</nav>"])))
def test_any_markup_is_tolerated(parts):
    text = main_text("".join(parts))
    assert text == " ".join(text.split())


def test_text_with_many_signs_that_open_no_tag():
    text = "a <b and c<d " * 200_000
    assert main_text(f"<article><p>One. Two.</p>{text}") == "One. Two. " + " ".join(text.split())
    assert main_text("<p>One. Two.</p> three <!-- open <p>hidden") == "One. Two. three"


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 9), (2, None, None, 9), (2, None, None, 9), (None, "v", "<p>é" + "x" * 200_000, 9)], "page_id long, url string, html string, text int")
    rows = extract_text(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in rows) == [(0, 200_001), (1, len(main_text(PAGE))), (2, 0), (2, 0)]
    assert extract_text(pages.limit(0)).count() == 0


# --- line dedup


def plain_dedup(docs, least=10):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    first, last = {}, {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            k = key(line)
            first[k], last[k] = min(first.get(k, doc), doc), max(last.get(k, doc), doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and first[key(x)] < last[key(x)] and first[key(x)] != doc)]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_lines_against_plain_version(make_docs, words):
    common = ["A Common Line Here ", "\tanother common one", "short", "ÉÉÉÉÉÉÉÉÉÉ", "ééééééééééé", "", "x" * 9, "y" * 10]
    docs = [(i, "\n".join([words(i, 4), common[i % 8].upper() if i % 3 else common[i % 8], words(i % 7, 5), common[(i * 3) % 8]])) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "a common line here\na common line here")]
    got = sorted(tuple(r) for r in dedup_lines(make_docs(docs)).collect())
    assert got == plain_dedup(docs)


def test_line_edge_cases(make_docs):
    same = "one repeated line\nand another line"
    rows = dedup_lines(make_docs([(1, same), (1, same), (2, same), (None, same), (2, "other text of two\none repeated line")]).withColumn("_id", F.lit(0))).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in rows) == [(0, 2), (1, 0), (1, 0), (2, 1), (2, 2)]
    assert dedup_lines(make_docs([])).count() == 0
    hot = dedup_lines(make_docs([(i, "the very same line\nown line number %d" % i) for i in range(3000)])).collect()
    assert sum(r["n_dropped"] for r in hot) == 2999


# --- token files


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
def test_codes_round_trip(values):
    control, data = pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert unpack(control, data, len(values)).tolist() == values


def test_common_ids_take_one_byte():
    control, data = pack(np.array([0, 1, 255, 256, 70_000], np.uint32))
    assert len(data) == 1 + 1 + 1 + 2 + 3


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA bB.'’sTLl1 2\n\t<|>İΣéÉ\xa0 \x1c"))))
def test_remembered_words_equal_the_tokenizer(text):
    coder = WordCoder.of(tokenizer_file())
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == tokenizer_once().encode(text, add_special_tokens=False).ids


def test_many_texts_are_encoded_at_a_time(monkeypatch):
    coder, plain, texts = WordCoder(tokenizer_file()), tokenizer_once(), []
    calls = []
    monkeypatch.setattr(token_output, "CACHE_WORDS", 40)
    monkeypatch.setattr(token_output, "PIECES_A_CALL", 7)
    pieces_of = coder._piece_ids
    monkeypatch.setattr(coder, "_piece_ids", lambda pieces: calls.extend(pieces) or pieces_of(pieces))
    for i in range(6):
        texts = ["", " ", f"Word{i} word the THE it's", "<|endoftext|> a", "e\u0301 İ Σ", "中文 ½ ² дом, дом", f" \u2003own\x85x{i}\xa0word. ", "the " * 50]
        texts += [f"{a}{b}{i}. {a}!?{b}" for a in "abcé" for b in "xyzß"]
        got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode_all(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert 0 < len(coder.words) == len(coder.ids) <= 40
    assert coder.encode_all([]) == [] and coder.encode_all(["", "İ"])[0] == b""
    # Words met again are remembered, those of one batch encoded once.
    assert calls.count("the") == 1 and calls.count("!?") <= 6


def test_pieces_whose_ends_are_not_marked(monkeypatch):
    coder = WordCoder(tokenizer_file())
    coder.ends[:] = False
    assert np.frombuffer(coder.encode("The cat's hats"), "<u4").tolist() == tokenizer_once().encode("The cat's hats", add_special_tokens=False).ids


def test_texts_in_sizes():
    rows = [(i, "x" * n) for i, n in enumerate([3, 9, 0, 0, 4, 5, 1])]
    groups = list(token_output.in_sizes(rows, 8))
    assert [r for g in groups for r in g] == rows
    assert [sum(len(t) for _, t in g) for g in groups] == [12, 9, 1]
    assert list(token_output.in_sizes([], 8)) == []


_TOKENIZER = []


def tokenizer_once():
    if not _TOKENIZER:
        _TOKENIZER.append(tokenizer())
    return _TOKENIZER[0]


def test_files_hold_the_corpus(spark, make_docs, words, tmp_dir):
    docs = [(i * 3 % 101, f"{words(i, 30)}, It's {i}!\n\tTHE end") for i in range(101)] + [(500, None), (501, ""), (502, "the " * 70_000)]
    encode_corpus(make_docs(docs).withColumn("part", F.lit("x")), tokenizer_file(), tmp_dir + "/t")
    rows = {r["doc_id"]: r for r in read_checksums(spark, tmp_dir + "/t").collect()}
    start, t = 0, tokenizer()
    for doc, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, END_ID]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(rows[doc]) == (doc, start, len(ids), crc)
        start += len(ids)
    assert len(rows) == len(docs)


def test_token_edge_cases(spark, make_docs, tmp_dir):
    encode_corpus(make_docs([]), tokenizer_file(), tmp_dir + "/e")
    assert read_corpus(spark, tmp_dir + "/e").count() == 0
    encode_corpus(make_docs([(7, "b c"), (7, "b c"), (None, "a"), (7, "d")]), tokenizer_file(), tmp_dir + "/r")
    rows = sorted(read_corpus(spark, tmp_dir + "/r").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 7, 7, 7]
    ends = np.cumsum([r["n_tokens"] for r in rows])
    assert [r["start"] for r in rows] == [0, *ends[:-1].tolist()]


def test_line_digest_of_kept_text(make_docs):
    r = dedup_lines(make_docs([(1, "é\nb")])).select(F.sha2(F.encode("text", "UTF-8"), 256).alias("h")).first()
    assert r["h"] == hashlib.sha256("é\nb".encode()).hexdigest()


PARAGRAPHS = [f"Paragraph {i} of the article, which is long enough; it says something, and more." for i in range(5)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
LINKS = '<div class="x9">' + "".join(f'<div><a href="/{i}">link number {i}</a></div>' for i in range(10)) + "</div>"
FOOT = '<div class="x7">All rights kept 2024</div>'


def test_links_and_footers_go_by_their_paths_whatever_their_names():
    want = " ".join(PARAGRAPHS)
    assert main_text(f"<html><body>{LINKS}{BODY}{LINKS}{FOOT}</body></html>") == want
    assert main_text(f"<body><div>{BODY}</div><div>{BODY}</div>{LINKS}{FOOT}</body>") == f"{want} {want}"
    assert main_text(f"<body>{FOOT}<article>{BODY}{LINKS}</article>{FOOT}</body>") == want
    assert main_text(f"<body><h1>Title</h1>{BODY}<ul><li>one</li><li>two</li></ul>{FOOT}</body>") == f"Title {want} one two"


def test_path_ratios_equal_their_definition():
    import math

    html = "<body><div><p>One, two. Three!</p><p>Four <a href=x>linked, text</a></p></div><ul><li>five</li></ul><p>Six; seven.</p></body>"
    blocks = html_extraction.text_blocks(html)
    paths = ["body div p", "body div p", "body ul li", "body p"]
    text = {"body div p": (15 + 5) / 2, "body ul li": 4, "body p": 11}
    marks = {"body div p": (3 + 1) / 2, "body ul li": 0, "body p": 2}
    _, alone = html_extraction.path_scores(blocks)
    assert [b.text for b in blocks] == ["One, two. Three!", "Four linked, text", "five", "Six; seven."]
    for p, b, score in zip(paths, blocks, alone, strict=True):
        mine = [x for x, q in zip(blocks, paths, strict=True) if q == p]
        t = sum(len(x.text) - x.linked for x in mine) / len(mine)
        m = sum(x.text.count(c) for x in mine for c in ",.!;") / len(mine)
        assert math.isclose(score, math.log1p(t) * math.log1p(1 + m))
        assert abs(t - text[p]) <= 1 and m == marks[p]


def test_hidden_inline_elements_end_at_their_own_tag():
    assert main_text("<body><p>a, b. <span hidden>h1<span>h2</span> h3</span>c.</p></body>") == "a, b. c."


def test_deep_and_long_pages_take_linear_time():
    import time

    start = time.time()
    for html in ("<div>x" * 40_000, "<div>" * 30_000 + "</span></p></div>" * 30_000, "<ul><li>x, y." * 30_000, "<div><p>text, more.</p>" * 40_000,
                 "<span hidden>" * 5000, "<p>a, b.<div>" * 30_000):
        main_text(html)
    assert time.time() - start < 25


def test_extraction_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", f"<body>{BODY}</body>", "t", 7)], "page_id long, url string, html string, text string, n_chars long")
    (row,) = html_extraction.extract_text(pages).collect()
    assert (row["text"], row["n_chars"]) == (" ".join(PARAGRAPHS), len(" ".join(PARAGRAPHS)))


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    texts = ["The cat's 12 hats.", " two  spaces\n", "ÉCOLE ß İ", "", "x" * 50, "<|endoftext|> a"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        plain, coder = Tokenizer.from_file(tokenizer_file(name)), WordCoder(tokenizer_file(name))
        assert coder.by_words == (name == "word_bpe_49k.json")
        for text in texts:
            assert np.frombuffer(coder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, (name, text)
