"""Corpus analytics on PySpark: text, provenance, quality, queue and manifest operators."""
