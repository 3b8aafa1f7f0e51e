"""Operators for large training-data corpora and their registered queries."""
