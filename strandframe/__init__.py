"""Genomics and biostatistics operators over Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame; nothing is executed
until the caller runs an action, except where an operator must look at a small
aggregate first (value split points, fitted coefficients).
"""

__version__ = "0.1.0"
