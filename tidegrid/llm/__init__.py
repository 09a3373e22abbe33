"""Operators for preparing language-model training data, on Spark DataFrames.

Nothing else in the library imports this subpackage.  Every operator takes the
columns it needs by name and selects them before it adds any of its own, so
other columns of the input never clash with internal ones.
"""
