"""textloom: a Spark-first full-text ranking engine and text data toolkit."""

__version__ = "0.1.0"
