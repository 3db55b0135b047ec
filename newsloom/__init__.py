"""newsloom: a PySpark-native engine for click logs, retrieval, ranking and evaluation."""

__version__ = "0.1.0"
