"""Operators for preparing training corpora: one module for each."""
