"""Scalar functions as Column expressions: vectors, knowledge graphs, space, sound, estimates."""
