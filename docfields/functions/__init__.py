"""Scalar columns."""
