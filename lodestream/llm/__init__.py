"""Operators for building training corpora: filters, de-duplication, tokenisation and packing."""
