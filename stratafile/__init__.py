"""stratafile: catalog, compare and de-duplicate very large file corpora on Spark."""

__version__ = "0.1.0"
