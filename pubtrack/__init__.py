"""pubtrack: publication tracking over Spark DataFrames."""

__version__ = "0.1.0"
