"""Entity cleaning and entity resolution on Spark DataFrames."""

__version__ = "0.1.0"
