"""funnelworks: e-commerce analytics on Spark DataFrames.

Sub-packages:

* ``sources``    – table readers, fixture derivations, connectors and sinks
* ``functions``  – column-expression helpers (paths, days, text, HTML fields)
* ``operators``  – batch jobs (funnel rollups, overview, sales, listings, extraction, envelopes)
* ``streaming``  – Structured Streaming ingest of keyed JSON message batches
* ``plans``      – the named queries and their SQL oracles
"""

from funnelworks.session import checkpoint_root, get_session, shared_path

__all__ = ["get_session", "checkpoint_root", "shared_path"]
