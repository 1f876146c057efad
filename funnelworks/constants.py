"""Fixed values.

These must equal the original service's values for the results to match. They are
listed in the order the data flows: events and funnels, overview, sales, listings,
product pages, messages.
"""

from __future__ import annotations

import datetime as dt

# --- Fixed values -------------------------------------------------------------------

# Events and funnels
CATEGORY_DELIMITER = "."
DAY_FORMAT = "yyyy-MM-dd"
FUNNEL_STAGES = ("view", "cart", "purchase")

# Overview
LABEL_FORMAT = "dd-MM-yyyy"
DEFAULT_CATEGORIES = ("accessories", "furniture", "sport", "appliances", "electronics")

# Sales and listings
ROLLUP_FIRST_DAY = dt.date(2024, 5, 1)
ROLLUP_LAST_DAY = dt.date(2024, 7, 12)
STAMP_START = dt.datetime(2024, 5, 1)
AMPLIFY_TARGET_BYTES = 2 * 1024**3
RESULT_ARRAYS = ("organic", "amazons_choices")
LISTING_FIELDS = "asin string, price double, line int"

# Product pages
SEARCH_LINK_CLASS = "a-link-normal s-underline-text s-underline-link-text s-link-style a-text-normal"
TITLE_ID = "productTitle"
TITLE_FALLBACK = ("h1", "title")
BRAND_ROW_CLASS = "po-brand"
PRICE_CLASS = "a-offscreen"
DISCOUNT_CLASS = "a-size-large a-color-price savingPriceOverride aok-align-center reinventPriceSavingsPercentageMargin savingsPercentage"
RATING_ICON_CLASS = "a-icon a-icon-star a-star-4-5"
RATING_ALT_CLASS = "a-icon-alt"
REVIEWS_ID = "acrCustomerReviewText"
AVAILABILITY_ID = "availability"
NOT_AVAILABLE = "Not Available"
DETAIL_TABLE_ID = "productDetails_detailBullets_sections1"

# Messages
BATCH_SIZE = 20
