"""Grounded facts on Spark: typed values with the context that makes them comparable and a verified quotation."""
