"""Scans and views: parquet tables, the review view, raw-row normalising, recipient lists."""
