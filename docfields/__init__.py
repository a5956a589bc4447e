"""Scanned-document OCR output to typed, validated and masked records, as Spark plans."""

__version__ = "1.0.0"
