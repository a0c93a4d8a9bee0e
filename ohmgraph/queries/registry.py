"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from . import graphs, ingest, learning

BOTH = ingest.BOTH | graphs.BOTH | learning.BOTH
QUERIES = {name: query for name, (query, _) in BOTH.items()}
ORACLES = {name: sql for name, (_, sql) in BOTH.items() if sql}
