"""Reductions, neighbour operators, joins and spectral operators on DataFrames."""
