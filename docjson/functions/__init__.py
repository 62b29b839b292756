"""Scalar functions on JSON pointers, formats, schemas and renderings."""
