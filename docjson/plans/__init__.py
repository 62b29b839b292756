"""Whole-document plans: the ordered extraction fold."""
