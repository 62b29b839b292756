"""Operators on JSON documents, chunks and messages."""
