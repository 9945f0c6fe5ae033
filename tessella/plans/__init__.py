"""Whole plans: corpus building, search, evaluation, and the driver queries."""
