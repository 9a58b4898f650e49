"""Expressions as native Spark columns."""
