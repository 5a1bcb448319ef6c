"""tributary: program-flow and event-flow analytics over Spark DataFrames."""

__version__ = "0.1.0"
