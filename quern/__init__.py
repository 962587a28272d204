"""quern: a Spark-native engine for wide, nested, entry-aligned tables."""

__version__ = "0.1.0"
