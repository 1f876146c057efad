"""Page table → product table and link table.

The reference downloads one page at a time, parses it and calls eight field getters. Here a
task splits the pages of its partition into nodes (``functions.markup``) and every field is a
column expression over them, so a query that reads two fields computes two. Pages never meet
other pages and nothing is shuffled. Products without a brand are kept aside as rejects instead
of being logged and lost. A table stored in fewer splits than the cluster has tasks is spread
by the caller (``pages.repartition(n)``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks import constants as C
from funnelworks.functions.html import absolute_url, parse_float, parse_int
from funnelworks.functions.markup import SPACE, elements, first, inside, let, only_string, strings, strip, text, with_nodes


def first_token(s: Column) -> Column:
    """The first word of a text; NULL without one."""
    return F.nullif(F.regexp_extract(s, rf"(?U)^{SPACE}*+((?:(?!{SPACE}).)++)", 1), F.lit(""))


def _title() -> Column:
    tag, id_ = C.TITLE_FALLBACK
    found = f"coalesce({first('nodes', id_=C.TITLE_ID)}, {first('nodes', tag, id_)})"
    return F.coalesce(F.expr(text(found)), F.lit(""))


def _brand() -> Column:
    cell = let(first("nodes", "tr", css=C.BRAND_ROW_CLASS), lambda row: f"get({elements(inside(row), 'td')}, 1)")
    return F.coalesce(F.expr(text(cell)), F.lit(""))


def _price(strip_commas: bool) -> Column:
    amount = F.expr(f"substring({only_string(first('nodes', 'span', css=C.PRICE_CLASS))}, 2)")
    return parse_float(F.replace(amount, F.lit(","), F.lit("")) if strip_commas else amount)


def _discount() -> Column:
    found = only_string(first("nodes", "span", css=C.DISCOUNT_CLASS))
    number = F.expr(let(found, lambda s: f"substring({s}, 2, greatest(length({s}) - 2, 0))"))
    return F.coalesce(parse_float(number), F.lit(0.0))


def _rating() -> Column:
    places = (("i", C.RATING_ICON_CLASS), ("span", C.RATING_ALT_CLASS))
    return F.coalesce(*[parse_float(first_token(F.expr(only_string(first("nodes", tag, css=css))))) for tag, css in places])


def _reviews() -> Column:
    token = first_token(F.expr(only_string(first("nodes", "span", id_=C.REVIEWS_ID))))
    return F.coalesce(parse_int(F.replace(token, F.lit(","), F.lit(""))), F.lit(0).cast("bigint"))


def _availability() -> Column:
    span = let(first("nodes", "div", id_=C.AVAILABILITY_ID), lambda block: first(inside(block), "span"))
    return F.coalesce(F.expr(only_string(span)), F.lit(C.NOT_AVAILABLE))


def _cell_text(cell: str) -> str:
    return f"array_join(transform({strings(inside(cell))}, t -> {strip('t')}), '')"


def _last_of_each_key(entries: str) -> str:
    """Entries ``(at, k, v)`` with the last value of a key at the place of its first."""

    def ends(s: str) -> str:
        firsts = f"filter({s}, (x, i) -> i = 0 OR get({s}, i - 1).k <> x.k)"
        lasts = f"filter({s}, (x, i) -> i = size({s}) - 1 OR get({s}, i + 1).k <> x.k)"
        return f"zip_with({firsts}, {lasts}, (a, b) -> struct(a.at AS at, a.k AS k, b.v AS v))"

    return f"array_sort({let(f'array_sort(transform({entries}, e -> struct(e.k AS k, e.at AS at, e.v AS v)))', ends)})"


def _detail() -> Column:
    def cells(row: str) -> str:
        found = let(inside(row), lambda c: f"struct({first(c, 'th')} AS th, {first(c, 'td')} AS td)")
        both = lambda p: f"struct({row}.at AS at, {_cell_text(f'{p}.th')} AS k, {_cell_text(f'{p}.td')} AS v)"
        return let(found, lambda p: f"CASE WHEN {p}.th IS NOT NULL AND {p}.td IS NOT NULL THEN {both(p)} END")

    def entries(table: str) -> str:
        return f"transform({elements(inside(table), 'tr')}, r -> {cells('r')})"

    # A row without both cells leaves the page without details.
    rows = let(first("nodes", "table", id_=C.DETAIL_TABLE_ID), entries)
    whole = let(rows, lambda r: f"CASE WHEN forall({r}, e -> e IS NOT NULL) THEN {_last_of_each_key(r)} END")
    found = F.expr(f"map_from_entries(transform({whole}, e -> struct(e.k, e.v)))")
    return F.coalesce(found, F.create_map().cast("map<string,string>"))


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", strip_commas: bool = False
) -> DataFrame:
    """Every page with its eight fields and ``accepted`` (brand present, P12).

    A price with a thousands separator is no float, as in the original (D7);
    ``strip_commas=True`` removes separators first so ``$1,299.00`` reads as 1299.0. Fields of
    elements that a page lacks have the original's defaults.
    """
    fields = with_nodes(pages, html_col, [id_col]).select(
        id_col,
        _title().alias("title"),
        _brand().alias("brand"),
        _price(strip_commas).alias("price"),
        _discount().alias("discount"),
        _rating().alias("rating"),
        _reviews().alias("reviews"),
        _availability().alias("availability"),
        _detail().alias("detail"),
    )
    return fields.withColumn("accepted", F.col("brand") != F.lit(""))


def extract_products(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", strip_commas: bool = False
) -> DataFrame:
    """Accepted products."""
    return extract_pages(pages, id_col, html_col, strip_commas).where("accepted").drop("accepted")


def rejected_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Pages skipped for a missing brand, with the reason (P12 complement)."""
    return (
        extract_pages(pages, id_col, html_col)
        .where(~F.col("accepted"))
        .select(id_col, "title", F.lit("missing_brand").alias("reason"))
    )


def extract_links(
    pages: DataFrame,
    id_col: str = "page_id",
    html_col: str = "html",
    url_col: str = "url",
    css_class: str | None = None,
) -> DataFrame:
    """Anchor targets of each page with their position and absolute URL."""
    named = pages.select(id_col, F.col(url_col).cast("string").alias(url_col), html_col)
    hrefs = F.expr(f"filter(transform({elements('nodes', 'a', css=css_class)}, n -> n.href), h -> h IS NOT NULL)")
    links = with_nodes(named, html_col, [id_col, url_col]).select(id_col, url_col, F.posexplode(hrefs).alias("position", "link"))
    return links.select(id_col, "position", "link", absolute_url("link", url_col).alias("url"))


def search_result_links(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url"
) -> DataFrame:
    """Product links of search-result pages: anchors with the result-link class."""
    return extract_links(pages, id_col, html_col, url_col, C.SEARCH_LINK_CLASS)


def detail_string(detail: str | Column) -> Column:
    """``k=v;k=v`` rendering of a detail map in entry order."""
    d = F.col(detail) if isinstance(detail, str) else detail
    return F.array_join(F.transform(F.map_entries(d), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
