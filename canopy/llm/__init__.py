"""Operators for text, code and vector corpora. Nothing outside this subpackage imports it."""
