"""Message, URL and file threat analytics on Spark DataFrames."""

__version__ = "0.1.0"
