"""Stateful operators, as streams and as batch twins."""
