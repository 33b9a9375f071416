"""Compositions of the operators, and views of their results."""
