"""Scalar functions, nearly all as native columns."""
