"""Operators for cleaning, selecting and packing training text. Nothing else in the package imports this folder."""
