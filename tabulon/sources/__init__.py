"""Readers and sinks: files (CSV/TSV/text/JSON/parquet), file manifests,
multi-source loads, appends, HTML tables harvested from a pages table."""
