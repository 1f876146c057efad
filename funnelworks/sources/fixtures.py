"""Input tables in the shapes the analytics read, derived on Spark from the given tables.

Each derivation is a lazy DataFrame over the whole input table; nothing is sampled or
capped. The rules are documented in FIXTURES.md §3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.constants import DISCOUNT_CLASS, SEARCH_LINK_CLASS
from funnelworks.operators.partitioning import shuffle_partitions
from funnelworks.sources.tables import read_table


def product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product events (E1): ``events`` joined to ``part`` on the ``k`` of ``props``.

    Columns: event_id, event_time, event_type, category_code, brand, price.
    The join is an equi-join; Spark/AQE picks broadcast only when the measured size of
    ``part`` is under the threshold, else sort-merge with skew splitting.
    """
    return of_products(spark, sf_dir, raw_events(spark, sf_dir))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events before they are joined to their products."""
    return read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value", "props"])


def of_products(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Those of some raw events that have a product, as product events."""
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
    keyed = events.withColumn(
        "k", F.get_json_object("props", "$.k").try_cast("bigint")
    )
    joined = keyed.join(part, F.col("k") == F.col("p_partkey"), "inner")
    noun = F.get(F.split("p_name", " "), 1)
    k10 = F.col("k") % 10
    return joined.select(
        "event_id",
        F.col("ts").alias("event_time"),
        F.when(F.col("event_type") == "click", F.lit("cart"))
        .otherwise(F.col("event_type"))
        .alias("event_type"),
        F.when(k10 == 0, F.lit(None).cast("string"))
        .when(k10 == 1, F.lower("p_type"))
        .otherwise(F.concat(F.lower("p_type"), F.lit("."), noun))
        .alias("category_code"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("k") % 7 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("value"))
        .alias("price"),
    )


def sales_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened listings with a timestamp and a price (E6), taken from ``lineitem``."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"])
    return li.select(
        F.col("l_orderkey").alias("response_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_extendedprice").alias("price"),
    )


# Listings per response page.
RESULTS_PER_PAGE = 20


def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON search responses per order and result page (E5, FIXTURES §3.3):
    ``response_id, page, body``.

    Lines with ``l_discount < 0.05`` are organic results, the rest "amazons_choices".
    ``l_orderkey % 11`` selects the shape: 0 list-shaped ``results``, 1 no ``content``,
    2 no ``amazons_choices`` key, otherwise both arrays. A page holds the lines numbered
    ``20·page+1 .. 20·page+20`` of one order (line numbers are unique per order), so no
    response grows with the size of an order.
    """
    li = read_table(
        spark, sf_dir, "lineitem",
        ["l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber", "l_discount"],
    )
    elem = F.struct(
        F.col("l_partkey").cast("string").alias("asin"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_linenumber").alias("line"),
    )
    organic = F.col("l_discount") < 0.05
    page = F.floor((F.col("l_linenumber") - 1) / RESULTS_PER_PAGE).cast("int")
    keyed = li.select("*", F.col("l_orderkey").alias("response_id"), page.alias("page"))
    # A list-collecting aggregate gains nothing from a map-side combine, so rows are
    # hash-partitioned on the group keys first (the aggregation reuses that exchange)
    # and the lists are built in parallel reducers.
    per_order = keyed.repartition("response_id", "page").groupBy("response_id", "page").agg(
        F.collect_list(F.when(organic, elem)).alias("organic"),
        F.collect_list(F.when(~organic, elem)).alias("amazons_choices"),
    )
    shape = F.col("response_id") % 11
    both = F.to_json(
        F.struct(F.struct(F.struct("organic", "amazons_choices").alias("results")).alias("content"))
    )
    organic_only = F.to_json(F.struct(F.struct(F.struct("organic").alias("results")).alias("content")))
    body = (
        F.when(shape == 0, F.lit('{"content":{"results":[1]}}'))
        .when(shape == 1, F.lit('{"status":"empty"}'))
        .when(shape == 2, organic_only)
        .otherwise(both)
    )
    return per_order.select("response_id", "page", body.alias("body"))


def _escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product detail page per part (FIXTURES §3.4): ``page_id, url, html``.

    Gaps by ``p_partkey``: %5=0 title in ``h1#title`` instead of ``#productTitle``;
    %7=0 no price; %3=0 a discount; %9=0 no brand row (rejected); %4=0 no availability.
    Prices of 1,000 or more carry a thousands separator (the reference's float() fails).
    Ordinary markup that a parser must read as a document: an attribute whose name ends like
    a sought one, a commented-out title, a character reference in every title, upper-case
    tags with single quotes, prices one element deeper (%2=0) or with a suffix (%11=0),
    blocks and cells with elements inside, tables without the end tags of their rows and
    cells (%8=0), markup that is none (%13=0).
    """
    # The small part rows are spread, not the generated pages: page text is built and parsed
    # in as many tasks as the session's shuffles have, and never shuffled.
    p = read_table(
        spark, sf_dir, "part",
        ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    ).repartition(shuffle_partitions(spark), "p_partkey")
    k = F.col("p_partkey")
    name, brand, ptype = _escape(F.col("p_name")), _escape(F.col("p_brand")), _escape(F.col("p_type"))
    empty = F.lit("")
    decoys = F.lit('<span data-id="productTitle">Other</span><!-- <span id="productTitle">Old</span> -->')
    name = F.concat(F.lit("&eacute; "), name)
    title = F.when(
        k % 5 == 0, F.concat(F.lit('<h1 id="title" class="a-size-large">\n      '), name, F.lit("\n    </h1>"))
    ).otherwise(F.concat(F.lit('<span id="productTitle" class="a-size-large product-title-word-break">\n      '), name, F.lit("\n    </span>")))
    amount = F.concat(
        F.lit("$"), F.format_number(F.col("p_retailprice") + F.col("p_size") * 10, 2),
        F.when(k % 11 == 0, F.lit("f")).otherwise(empty),
    )
    amount = F.when(k % 2 == 0, F.concat(F.lit("<b>"), amount, F.lit("</b>"))).otherwise(amount)
    price = F.when(k % 7 == 0, empty).otherwise(
        F.concat(F.lit('<span class="a-price"><span class="x a-offscreen">'), amount, F.lit("</span></span>"))
    )
    discount = F.when(
        k % 3 == 0,
        F.concat(F.lit(f'<span class="{DISCOUNT_CLASS}">-'), F.col("p_size").cast("string"), F.lit("%</span>")),
    ).otherwise(empty)
    rating = F.concat(
        F.lit('<span class="a-icon-alt">'), ((F.col("p_size") % 5) + 0.5).cast("string"),
        F.lit(" out of 5 stars</span>"),
    )
    reviews = F.concat(
        F.lit("<SPAN class='a-size-base' ID='acrCustomerReviewText'>"),
        F.format_number(k * 37, 0), F.lit(" ratings</SPAN>"),
    )
    availability = F.when(k % 4 == 0, empty).otherwise(
        F.lit('<div id="availability" class="a-section a-spacing-base">'
              '<div class="pre"><div></div></div><span class="a-size-medium a-color-success">\n        In Stock\n      </span></div>')
    )
    brand_row = F.when(k % 9 == 0, empty).otherwise(
        F.concat(F.lit('<table class="a-normal"><tr class="a-spacing-small po-brand">'
                       '<td class="a-span3"><span class="a-text-bold">Brand</span></td>'
                       '<td class="a-span9"><span class="po-break-word">'),
                 brand, F.lit("</span></td></tr></table>"))
    )
    detail = F.concat(
        F.lit('<table id="productDetails_detailBullets_sections1" class="a-keyvalue prodDetTable">'
              '<tr><th class="a-color-secondary prodDetSectionEntry"> Type </th>'
              '<td class="a-size-base prodDetAttrValue"> '),
        ptype,
        F.lit(' </td></tr><tr><th class="a-color-secondary prodDetSectionEntry"> Size </th>'
              '<td class="a-size-base prodDetAttrValue"> '),
        F.col("p_size").cast("string"),
        F.lit(" </td></tr><tr><th>Pack</th><td> A <b>B</b> C </td></tr></table>"),
    )
    for end in ("</td>", "</tr>", "</th>"):
        brand_row, detail = (F.when(k % 8 == 0, F.replace(t, F.lit(end), empty)).otherwise(t) for t in (brand_row, detail))
    odd = F.when(k % 13 == 0, F.lit("<![odd[ x ]]><p>unclosed<div></b></div>")).otherwise(empty)
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), name, F.lit("</title></head><body><div id=\"dp\">\n"), odd,
        decoys, title, price, discount, rating, reviews, availability, brand_row, detail,
        F.lit("\n</div></body></html>"),
    )
    return p.select(
        k.alias("page_id"),
        F.concat(F.lit("https://shop.example.com/dp/"), k.cast("string")).alias("url"),
        html.alias("html"),
    )


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search-result page per part: ``page_id, url, html`` with two result links (one with
    a character reference, one in single quotes beside a ``data-href``), and links that are
    none: another class, and one commented out."""
    k = read_table(spark, sf_dir, "part", ["p_partkey"]).select(F.col("p_partkey").cast("string").alias("k"))
    k = k.repartition(shuffle_partitions(spark), "k")
    html = F.concat(
        F.lit(f'<html><body><a class="a-link-normal" href="/nav">n</a><!-- <a class="{SEARCH_LINK_CLASS}" href="/old">o</a> -->'
              f'<a class="{SEARCH_LINK_CLASS}" href="/dp/'),
        F.col("k"), F.lit("""?a=1&amp;b=2">1</a><A data-href='/wrong' HREF='/alt/"""),
        F.col("k"), F.lit(f"' class='{SEARCH_LINK_CLASS}'>2</A></body></html>"),
    )
    return k.select(
        F.col("k").cast("bigint").alias("page_id"), F.lit("https://shop.example.com/s?k=a").alias("url"), html.alias("html")
    )


def mixed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search response per order line, ``response_id, body``: listings with fields
    beyond the declared ones, a price that is no number (%3=0), a non-object beside the
    listing (%5=0), and bodies that are no JSON (%13=0); modulo on the line's part."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    # The small rows are spread, so that bodies are built and parsed by many tasks.
    li = li.repartition(shuffle_partitions(spark), "l_orderkey", "l_linenumber")
    k = F.col("l_partkey")
    listing = F.concat(
        F.lit('{"asin":"'), k.cast("string"), F.lit('","price":'),
        F.when(k % 3 == 0, F.lit('"n/a"')).otherwise(F.col("l_extendedprice").cast("string")),
        F.lit(',"line":'), F.col("l_linenumber").cast("string"),
        F.lit(',"seller":{"id":'), F.col("l_orderkey").cast("string"), F.lit("}}"),
    )
    more = F.when(k % 5 == 0, F.lit(",7")).otherwise(F.lit(""))
    body = F.when(k % 13 == 0, F.lit('{"content":')).otherwise(
        F.concat(F.lit('{"content":{"results":{"organic":['), listing, more, F.lit("]}}}"))
    )
    return li.select(F.col("l_orderkey").alias("response_id"), body.alias("body"))


def typed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message per part (``key, value``) by ``p_partkey % 4``: a field that does not convert,
    a null among the items, a number as text, a null field."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    k, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    value = (
        F.when(kind == 0, F.concat(F.lit('[{"id":'), k, F.lit(',"price":"x"}]')))
        .when(kind == 1, F.concat(F.lit('[null,{"id":'), k, F.lit("}]")))
        .when(kind == 2, F.concat(F.lit('[{"id":'), k, F.lit(',"price":"12.5"}]')))
        .otherwise(F.concat(F.lit('[{"id":'), k, F.lit(',"price":null}]')))
    )
    return p.select(F.col("p_name").alias("key"), value.alias("value"))


def rich_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message per part (``key, value``) of two items with fields beyond the declared ones."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size", "p_type"])
    k = F.col("p_partkey").cast("string")
    value = F.concat(
        F.lit('[{"id":'), k, F.lit(',"kind":"'), F.col("p_type"), F.lit('","box":{"size":'), F.col("p_size").cast("string"),
        F.lit('}},{"id":-'), k, F.lit(',"price":1.5,"tags":["a",null]}]'),
    )
    return p.select(F.col("p_name").alias("key"), value.alias("value"))


# Kinds of invalid message derived from each part, by ``p_partkey % 6``.
BAD_MESSAGE_KINDS = 6


def envelope_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped items keyed by product term (FIXTURES §3.5): ``key, id, brand, price``."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_retailprice"])
    return p.select(
        F.col("p_name").alias("key"),
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("p_retailprice"))
        .alias("price"),
    )


def bad_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invalid message per part (``key, value``), kind by ``p_partkey % 6``: NULL key,
    empty key, single object, truncated JSON, NULL value, list of non-objects."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    k = F.col("p_partkey")
    ks = k.cast("string")
    kind = k % BAD_MESSAGE_KINDS
    one = F.concat(F.lit('[{"id": '), ks, F.lit("}]"))
    key = F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, F.lit("")).otherwise(F.col("p_name"))
    value = (
        F.when(kind <= 1, one)
        .when(kind == 2, F.concat(F.lit('{"id": '), ks, F.lit(', "brand": "'), F.col("p_brand"), F.lit('"}')))
        .when(kind == 3, F.concat(F.lit('[{"id": '), ks, F.lit(",")))
        .when(kind == 4, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("["), ks, F.lit("]")))
    )
    return p.select(key.alias("key"), value.alias("value"))
