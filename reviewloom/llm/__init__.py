"""Training-data operators: language ID, near-duplicate join, exact dedup,
mixing, license scans, decontamination, PII, quality, token files and WARC."""
