"""Lenient HTML trees: parsing, surgery, tokenisation, annotation, comparison."""
