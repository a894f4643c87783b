"""Scalar functions as native Column expressions."""
