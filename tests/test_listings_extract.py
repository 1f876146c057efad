import json

from pyspark.sql import functions as F

from funnelworks.constants import AVAILABILITY_ID, BRAND_ROW_CLASS, DETAIL_TABLE_ID, DISCOUNT_CLASS, PRICE_CLASS, RATING_ICON_CLASS, SEARCH_LINK_CLASS, TITLE_ID
from funnelworks.operators import extract, listings


def _responses(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "response_id bigint, body string")


def test_flatten_shapes(spark):
    item = {"asin": "a", "price": 1.5, "line": 1, "extra": "ignored"}
    bodies = [
        json.dumps({"content": {"results": {"organic": [item, item], "amazons_choices": [item]}}}),
        json.dumps({"content": {"results": [1]}}),                  # list-shaped results: skipped
        json.dumps({"status": "empty"}),                            # no content
        json.dumps({"content": {"results": {"organic": [item]}}}),  # missing choices (D11)
        json.dumps({"content": {"results": {"amazons_choices": [item]}}}),  # missing organic (D11)
        "{not json",
        None,
    ]
    out = listings.flatten_listings(_responses(spark, bodies)).collect()
    kinds = sorted((r.response_id, r.kind) for r in out)
    assert kinds == [(0, "amazons_choices"), (0, "organic"), (0, "organic"), (3, "organic"), (4, "amazons_choices")]
    assert all(r.price == 1.5 and r.asin == "a" for r in out)


def test_amplify_and_copies(spark):
    df = spark.range(10)
    assert listings.amplify(df, 3).count() == 30
    assert listings.amplify(df, 3).select("copy").distinct().count() == 3
    assert listings.amplify(df, 0).count() == 0
    assert listings.copies_for_target(100, 250) == 3
    assert listings.copies_for_target(0, 250) == 0


def test_random_stamp_in_window(spark):
    import datetime as dt

    start, end = dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 2)
    df = listings.random_stamp(spark.range(1000), start, end, seed=1)
    lo, hi = df.agg(F.min("timestamp"), F.max("timestamp")).first()
    assert start <= lo <= hi <= end


PAGE = f"""<html><body>
<span id="productTitle">
   Fancy &amp; Co Lamp
</span>
<span class="a-price"><span class="a-offscreen">$1,299.00</span></span>
<span class="{DISCOUNT_CLASS}">-20%</span>
<i class="{RATING_ICON_CLASS}"><span>4.5 out of 5 stars</span></i>
<span class="a-icon-alt">3.0 out of 5 stars</span>
<span id="acrCustomerReviewText">1,299 ratings</span>
<table><tr class="po-brand"><td>Brand</td><td> <span>Lumo</span> </td></tr></table>
<table id="{DETAIL_TABLE_ID}">
<tr><th> Color </th><td> Red </td></tr><tr><th>Color</th><td>Blue</td></tr><tr><th>Size</th><td>L</td></tr>
</table>
</body></html>"""

PAGE2 = f"""<html><body><h1 id="title"> Plain Title </h1>
<span class="a-offscreen">$12.50</span>
<span class="a-icon-alt">2.5 out of 5 stars</span>
<div id="availability"><span>
 Only 3 left
</span></div>
<table id="{DETAIL_TABLE_ID}"><tr><th>Weight</th></tr></table>
</body></html>"""


def test_extract_fields(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, PAGE2), (3, "<html></html>")], "page_id bigint, html string")
    rows = {r.page_id: r for r in extract.extract_pages(pages).collect()}
    a, b, c = rows[1], rows[2], rows[3]
    assert a.title == "Fancy & Co Lamp" and a.brand == "Lumo" and a.accepted
    assert a.price is None                     # thousands separator -> float() fails (D7)
    assert a.discount == 20.0 and a.rating == 4.5 and a.reviews == 1299
    assert a.availability == "Not Available"
    assert a.detail == {"Color": "Blue", "Size": "L"}   # later header wins
    assert b.title == "Plain Title" and b.price == 12.5 and b.discount == 0.0
    assert b.rating == 2.5 and b.reviews == 0 and b.availability == "Only 3 left"
    assert b.detail == {} and b.brand == "" and not b.accepted   # row without td -> {}
    assert (c.title, c.price, c.rating, c.reviews, c.detail) == ("", None, None, 0, {})


def test_rejects_are_complement(spark):
    from funnelworks.sources import fixtures
    from tests.conftest import SMOKE_DIR

    pages = fixtures.product_pages(spark, SMOKE_DIR)
    n = pages.count()
    assert extract.extract_products(pages).count() + extract.rejected_pages(pages).count() == n


def test_links_absolute(spark):
    pages = spark.createDataFrame(
        [(1, "https://h.example.com/a/b?x=1", '<a href="/p">x</a><a class="k" href="https://o.example/q">y</a><a href="rel">z</a><a href="//cdn.example/i">i</a>')],
        "page_id bigint, url string, html string",
    )
    got = [(r.position, r.url) for r in extract.extract_links(pages).orderBy("position").collect()]
    assert got == [(0, "https://h.example.com/p"), (1, "https://o.example/q"), (2, "https://h.example.com/rel"), (3, "https://cdn.example/i")]


def test_read_responses_from_text_files(spark, tmp_dir):
    from funnelworks.sources.connectors import read_responses

    item = {"asin": "a", "price": 1.0, "line": 1}
    docs = [
        json.dumps({"content": {"results": {"organic": [item], "amazons_choices": [item, item]}}}),
        json.dumps({"content": {"results": [1]}}),
    ]
    path = f"{tmp_dir}/responses"
    spark.createDataFrame([(d,) for d in docs], "value string").write.text(path)
    resp = read_responses(spark, path)
    assert resp.select("response_id").distinct().count() == 2
    assert listings.flatten_listings(resp).count() == 3


def test_stamped_listings_fall_in_rollup_window(spark):
    from funnelworks import api, constants

    bodies = [json.dumps({"content": {"results": {"organic": [{"asin": str(i), "price": 1.0, "line": i} for i in range(1, 30)]}}})]
    flat = listings.flatten_listings(_responses(spark, bodies))
    stamped = listings.modular_stamp(flat, {"response_id": 7919, "line": 104729}, constants.STAMP_START, 6_220_800)
    daily = api.daily_sales(stamped)
    assert daily.agg(F.sum("sales")).first()[0] == 29.0


def test_search_result_links_only_result_class(spark):
    html = (
        f'<a href="/nav">n</a><a class="{SEARCH_LINK_CLASS}" href="/dp/1">1</a>'
        f'<a href="/dp/2" class="{SEARCH_LINK_CLASS}">2</a><a class="a-link-normal" href="/x">x</a>'
    )
    pages = spark.createDataFrame([(1, "https://s.example.com/s?k=a", html)], "page_id bigint, url string, html string")
    got = [r.url for r in extract.search_result_links(pages).orderBy("position").collect()]
    assert got == ["https://s.example.com/dp/1", "https://s.example.com/dp/2"]
    assert extract.extract_links(pages).count() == 4


def test_strip_commas_option(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id bigint, html string")
    assert extract.extract_pages(pages).first().price is None
    assert extract.extract_pages(pages, strip_commas=True).first().price == 1299.0


def test_flatten_keeps_documents_and_names_rejects(spark):
    odd = {"asin": "b", "price": "n/a", "line": 2, "seller": {"id": 9}}
    bodies = [
        json.dumps({"content": {"results": {"organic": [odd, None, 7, {}], "amazons_choices": []}}}),
        json.dumps({"content": {"results": [1]}}),
        '{"content":',
        '{"content":{"results":{"organic":[{"asin":"a","asin":"b"}]}}}',   # a repeated key
        None,
    ]
    responses = _responses(spark, bodies)
    flat = listings.flatten_listings(responses, document_col="listing").collect()
    assert [(r.asin, r.price, r.line) for r in flat] == [("b", None, 2), (None, None, None)]
    assert json.loads(flat[0].listing) == odd
    got = sorted((r.response_id, r.reason) for r in listings.flatten_rejects(responses).collect())
    assert got == [(0, "element_not_an_object"), (0, "element_not_an_object"), (1, "results_not_an_object"),
                   (2, "malformed_json"), (3, "malformed_json"), (4, "malformed_json")]
    assert listings.flatten_listings(responses)._jdf.queryExecution().executedPlan().toString().count("parseJson(") == 1


def _fields(spark, *pages):
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    return [r.asDict() for r in extract.extract_pages(frame).orderBy("page_id").collect()]


def _hrefs(spark, html):
    frame = spark.createDataFrame([(1, "https://h.example", html)], "page_id int, url string, html string")
    return [r.link for r in extract.extract_links(frame).orderBy("position").collect()]


def test_pages_are_read_as_documents(spark):
    none, empty, f, two, deep = _fields(
        spark,
        None,
        "",
        "<SPAN ID='productTitle'>A <script>x</script>&#8217;B&nbsp;</SPAN>"
        "<span class='a-offscreen'>&pound;12.00</span>"
        "<span id=acrCustomerReviewText>3,000,000,000 ratings</span>"
        "<div id='availability'><div><div></div></div><span><b> In Stock </b></span></div>"
        "<table><tr class='z po-brand'><td>B</td><td><table><td>x</td></table> y</td></tr></table>",
        "<span class='a-offscreen'><b>$1</b>2</span><div id='availability'><span></span></div>",
        "<div>" * 20_000 + "<span id='productTitle'>deep",
    )
    assert none["title"] == "" and empty["reviews"] == 0 and none["detail"] == {}
    assert f["title"] == "A \u2019B" and f["price"] == 12.0 and f["reviews"] == 3_000_000_000
    assert f["availability"] == "In Stock" and f["brand"] == "x y"
    assert two["price"] is None and two["availability"] == "Not Available"
    assert deep["title"] == "deep"
    assert _hrefs(spark, "<a href='/x?a=1&amp;b=2' data-href='/no'>1</a><!-- <a href='/c'> --><a>none</a>") == ["/x?a=1&b=2"]


def test_pages_with_omitted_end_tags(spark):
    rows = "<tr><th>Type<td>Book<tr><th>Size<td>3"
    f, odd, bold = _fields(
        spark,
        f"<table><tr class=po-brand><td>Brand<td>Acme<tr><td>Colour<td>Red</table><table id={DETAIL_TABLE_ID}><tbody>{rows}</table>",
        "<p id=productTitle>Lamp<p>more<ul><li>a<li>b</ul><div id=availability><span>Here</div>",
        # an end tag does not close what outranks it
        "<b><div><span id=productTitle>One</b> two</span></div>",
    )
    assert f["brand"] == "Acme" and f["detail"] == {"Type": "Book", "Size": "3"}
    assert odd["title"] == "Lamp" and odd["availability"] == "Here"
    assert bold["title"] == "One two"


def test_pages_go_on_behind_bad_markup(spark):
    f = _fields(
        spark,
        "<![foo[ x ]]><span id='productTitle'>T</span>",
        "<a title='it>s'><span id=productTitle class=\"x y>U</span>",
        "<span id=productTitle>1 < 2 <3</span> <",
        "<script>if (a < b) '<span id=productTitle>no</span>'</script><span id=productTitle>V",
        "<!-- open <span id=productTitle>no</span>",
    )
    assert [x["title"] for x in f] == ["T", "U", "1 < 2 <3", "V", ""]


def test_details_of_a_long_table_and_repeated_keys(spark):
    import time

    table = f"<table id={DETAIL_TABLE_ID}>" + "".join(f"<tr><th>k{i % 6000}<td>v{i}" for i in range(10_000)) + "</table>"
    start = time.time()
    frame = spark.createDataFrame([(1, table)], "page_id int, html string")
    found = extract.extract_pages(frame).select(extract.detail_string("detail").alias("d")).first().d.split(";")
    assert time.time() - start < 15
    assert len(found) == 6000 and found[:2] == ["k0=v6000", "k1=v6001"] and found[-1] == "k5999=v5999"


def test_markup_is_read_in_linear_time():
    import time

    from funnelworks.functions.markup import _Page

    start = time.time()
    for html in ("<div>" * 60_000 + "</p>" * 60_000, "<a b='" * 60_000, "<" * 300_000, "<td><div>" * 40_000, "<ul><li>" * 40_000, "<!--" * 80_000,
                 "<p>" + "<span>" * 30_000 + "<li></li>" * 30_000, "<a " * 80_000 + ">", "</b" * 60_000):
        _Page(html)
    assert time.time() - start < 12


def test_rejected_pages_compute_brand_and_title_alone(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id bigint, html string")
    plan = extract.rejected_pages(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert BRAND_ROW_CLASS in plan and TITLE_ID in plan
    assert DETAIL_TABLE_ID not in plan and PRICE_CLASS not in plan and AVAILABILITY_ID not in plan


def test_many_copies_are_made_by_several_tasks(spark):
    out = listings.amplify(spark.range(3).coalesce(1), 20_500)
    assert out.count() == 61_500 and out.select("id", "copy").distinct().count() == 61_500
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_number_syntax(spark):
    from funnelworks.functions.html import is_number

    texts = ["1", " 1.5e3 ", "1_000", "-.5", "nan", "Infinity", "1d", "2f", "0x1p3", "1__0", "", "1,0", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(is_number("t")).collect()
    assert [r[0] for r in got] == [True] * 6 + [False] * 7
