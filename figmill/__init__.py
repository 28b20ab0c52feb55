"""figmill: a PySpark-native engine for figure-reuse data processing.

Everything is expressed on DataFrames; Python is entered only through Arrow
batches, where no built-in expression gives the semantics.
"""

__version__ = "0.1.0"
