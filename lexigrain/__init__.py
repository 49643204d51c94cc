"""lexigrain: full-text indexing, search and text analytics on PySpark."""

__version__ = "0.1.0"
