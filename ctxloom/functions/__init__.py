"""Subpackage of ctxloom."""
