"""Operators over DataFrames: rule guards, provenance, prediction, joins of rules."""
