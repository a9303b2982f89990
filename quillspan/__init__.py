"""Span detection, redaction, layout and page-set analytics on PySpark."""
