"""Operators of a training-data pipeline over text tables, and their queries."""
