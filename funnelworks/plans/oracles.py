"""DuckDB SQL oracles for the named queries.

Each string runs on the driver's pre-registered views (one per input table) and must
produce the same rows and column names as the Spark query of the same name. The SQL
restates the fixture derivations independently of the Spark code path.
"""

from __future__ import annotations

# Fixture derivation of product events (FIXTURES §3.1), shared by the funnel queries.
PRODUCT_EVENTS_CTE = """
product_events AS (
  SELECT e.event_id,
         e.ts AS event_time,
         CASE WHEN e.event_type = 'click' THEN 'cart' ELSE e.event_type END AS event_type,
         CASE WHEN e.k % 10 = 0 THEN NULL
              WHEN e.k % 10 = 1 THEN lower(p.p_type)
              ELSE lower(p.p_type) || '.' || list_extract(string_split(p.p_name, ' '), 2)
         END AS category_code,
         p.p_brand AS brand,
         CASE WHEN e.k % 7 = 0 THEN NULL ELSE e.value END AS price
  FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
  JOIN part p ON e.k = p.p_partkey
)"""

FUNNEL_ROWS_CTE = """
funnel_rows AS (
  SELECT list_extract(string_split(category_code, '.'), 1) AS category,
         CAST(event_time AS DATE) AS event_day,
         list_extract(string_split(category_code, '.'), 2) AS classification,
         brand, event_type, price, event_id
  FROM product_events
  WHERE list_extract(string_split(category_code, '.'), 1) IS NOT NULL
)"""

FUNNEL_CTE = """
funnel AS (
  SELECT category, event_day, classification, brand,
         CAST(count_if(event_type = 'view') AS BIGINT) AS view,
         CAST(count_if(event_type = 'cart') AS BIGINT) AS cart,
         CAST(count_if(event_type = 'purchase') AS BIGINT) AS purchase,
         CAST(count(*) AS BIGINT) AS n_prices,
         CAST(count_if(price IS NULL) AS BIGINT) AS n_null_prices,
         min(price) AS min_price,
         max(price) AS max_price,
         round(sum(price), 2) AS sum_price
  FROM funnel_rows
  GROUP BY category, event_day, classification, brand
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def overview_ctes(from_day: str, to_day_exclusive: str, categories: list[str]) -> list[str]:
    cats = ", ".join(f"'{c}'" for c in categories)
    pivot_cols = ",\n         ".join(
        f"CAST(count_if(category = '{c}') AS BIGINT) AS {c}" for c in categories
    )
    return [
        f"""
overview_rows AS (
  SELECT list_extract(string_split(category_code, '.'), 1) AS category,
         CAST(event_time AS DATE) AS event_day
  FROM product_events
  WHERE category_code IS NOT NULL
    AND event_time >= TIMESTAMP '{from_day} 00:00:00'
    AND event_time < TIMESTAMP '{to_day_exclusive} 00:00:00'
    AND list_extract(string_split(category_code, '.'), 1) IN ({cats})
)""",
        f"""
overview_pivot AS (
  SELECT event_day,
         {pivot_cols}
  FROM overview_rows GROUP BY event_day
)""",
    ]
