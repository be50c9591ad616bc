"""Lexers, packrat parsing-expression grammars and generalised LL parsing of source code."""
