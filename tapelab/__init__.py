"""tapelab: tick and trade-tape research operators on PySpark DataFrames."""

__version__ = "0.1.0"
