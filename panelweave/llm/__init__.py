"""Operators for preparing text corpora: dedup, filters, mixing, search and token files. Nothing else imports it."""
