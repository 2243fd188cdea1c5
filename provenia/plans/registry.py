"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import queries_more, queries_store, queries_text

QUERIES = {**queries_text.QUERIES, **queries_store.QUERIES, **queries_more.QUERIES}
ORACLES = {**queries_text.ORACLES, **queries_store.ORACLES, **queries_more.ORACLES}
