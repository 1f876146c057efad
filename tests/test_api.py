from funnelworks import api


def test_api_surface_is_complete():
    for name in api.__all__:
        assert callable(getattr(api, name)), name
    # one entry per data endpoint / script of the original service
    for name in ("first_event", "category_statistics", "sales_change", "category_overview",
                 "daily_product_funnel", "daily_sales", "flatten_listings", "stamp_timestamps",
                 "amplify", "extract_products", "extract_links", "batch_envelopes", "ingest_stream"):
        assert name in api.__all__
