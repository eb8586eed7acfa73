"""kinfold: deterministic entity resolution and table tooling on Spark DataFrames."""

__version__ = "0.1.0"
