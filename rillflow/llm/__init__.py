"""Operators for preparing training data: ten of them, and the queries that apply them to whole tables."""
