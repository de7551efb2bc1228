"""Operators for preparing text corpora and searching vectors. Nothing outside this subpackage imports it."""
