"""Structured entity extraction for web pages, expressed as Spark plans."""
