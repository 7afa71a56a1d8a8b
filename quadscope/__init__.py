"""A Spark-native profiler of RDF quad datasets."""

__version__ = "0.2"
