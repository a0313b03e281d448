"""scenarium: structured scene descriptions, their evaluation and their upkeep, on Spark DataFrames."""

__version__ = "0.1.0"
