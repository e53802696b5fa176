"""loamdex: a Spark-native index, retrieval and graph-analytics engine for code and document corpora."""

__version__ = "0.1.0"
