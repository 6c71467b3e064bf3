"""Statements that Spark's parser does not know, and the choice among models."""
