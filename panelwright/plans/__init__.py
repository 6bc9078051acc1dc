"""Compositions of operators: panels and experiments."""
