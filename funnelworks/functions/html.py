"""Column expressions beside page parsing: numbers in text and absolute URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"\d+(?:_\d+)*"
# What Python's float() takes, which is less (1d, 0x1p3) and more (1_000) than a SQL cast.
FLOAT_PATTERN = (
    r"(?iU)^\s*[+-]?(?:inf|infinity|nan"
    rf"|(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?)\s*$"
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_number(s: str | Column) -> Column:
    """Does the text convert to a float (F17)? Never raises; NULL does not."""
    return F.coalesce(_col(s).rlike(FLOAT_PATTERN), F.lit(False))


def parse_float(s: str | Column) -> Column:
    """The number of a text that ``is_number`` takes; NULL for others."""
    digits = F.replace(F.regexp_replace(_col(s), r"(?U)[\s\x1c-\x1f]", ""), F.lit("_"), F.lit(""))
    return F.when(is_number(s), digits.try_cast("double"))


def parse_int(s: str | Column) -> Column:
    """The whole number of a text as Python's int() reads it; NULL for others and beyond a long."""
    digits = F.replace(F.regexp_replace(_col(s), r"(?U)[\s\x1c-\x1f]", ""), F.lit("_"), F.lit(""))
    return F.when(_col(s).rlike(rf"(?U)^\s*[+-]?{_DIGITS}\s*$"), digits.try_cast("bigint"))


def absolute_url(link: str | Column, page_url: str | Column) -> Column:
    """Resolve a link against the page's ``scheme://host``.

    Absolute links and protocol-relative links are kept; a path gets the page origin.
    """
    link_c, page_c = _col(link), _col(page_url)
    origin = F.regexp_extract(page_c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(page_c, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return (
        F.when(link_c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link_c)
        .when(link_c.startswith("//"), F.concat(scheme, link_c))
        .when(link_c.startswith("/"), F.concat(origin, link_c))
        .otherwise(F.concat(origin, F.lit("/"), link_c))
    )
