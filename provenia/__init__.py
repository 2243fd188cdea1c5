"""Evidence-grounded claims on Spark: gates, linking, resolution, retrieval, provenance, ledger, streaming."""
