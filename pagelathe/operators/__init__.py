"""Relational and array operators over pages, words, boxes and structures."""
