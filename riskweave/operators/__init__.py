"""Operators over DataFrames: rules, joins, graphs, paths, dependencies, history."""
