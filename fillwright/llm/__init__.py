"""Operators over training documents, pages and vectors, with their queries."""
