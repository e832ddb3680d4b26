"""Scalar, generator and aggregate functions."""
