"""Operators for building training corpora: tokenising, licence scans, language
identification, deduplication, source mixing, surrogates for personal data,
toxicity scores and media columns.  Nothing outside this package imports it."""
