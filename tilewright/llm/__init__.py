"""Training-data operators: deduplication, language ID, PII surrogates, licence
scans, mixing, WARC archives, media columns, quality rules, tokenisation, sharding.

Nothing outside this subpackage imports it.
"""
