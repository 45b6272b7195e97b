"""Point-in-time contest analytics, declared on Spark DataFrames."""

__version__ = "0.1.0"
